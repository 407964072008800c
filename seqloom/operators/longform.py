"""Alignments as rows of text and as rows of residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESIDUE = "[A-Za-z]"
#: What may stand in an aligned row besides residues.
GAPS = "-.~ "


def explode_alignment(wide: DataFrame) -> DataFrame:
    """family, run_id, rank, col, ch, pos from rows of aligned text; no shuffle: a row knows its own residues.

    pos is the index of a residue in its row, null for a gap.  A row is taken apart once, so work is linear in its width.
    """
    cells = F.transform(F.split("aligned", ""), lambda c, i: F.struct(i.cast("long").alias("col"), c.alias("ch")))
    letter = lambda x: x["ch"].rlike(RESIDUE)
    own = F.transform(F.filter(cells, letter), lambda x, i: F.struct(x["col"].alias("col"), x["ch"].alias("ch"), i.cast("long").alias("pos")))
    rest = F.transform(F.filter(cells, lambda x: ~letter(x)), lambda x: F.struct(x["col"].alias("col"), x["ch"].alias("ch"), F.lit(None).cast("long").alias("pos")))
    keys = [c for c in ("family", "run_id", "rank") if c in wide.columns]
    return wide.filter(F.length("aligned") > 0).select(*keys, F.explode(F.concat(own, rest)).alias("c")).select(*keys, "c.col", "c.ch", "c.pos")


def explode_columns(wide: DataFrame) -> DataFrame:
    """family, run_id, rank, col, ch: as explode_alignment, for what needs no index of residues."""
    keys = [c for c in ("family", "run_id", "rank") if c in wide.columns]
    cells = wide.filter(F.length("aligned") > 0).select(*keys, F.posexplode(F.split("aligned", "")).alias("col", "ch"))
    return cells.withColumn("col", F.col("col").cast("long"))


def places(aligned: Column) -> Column:
    """Columns of a row's residues, in order."""
    cols = F.transform(F.split(aligned, ""), lambda c, i: F.when(~F.contains(F.lit(GAPS), c), i))
    return F.when(F.length(aligned) == 0, F.array().cast("array<int>")).otherwise(F.filter(cols, lambda i: i.isNotNull()))


def residues(wide: DataFrame) -> DataFrame:
    """family, run_id, rank, col, pos of every residue."""
    keys = [c for c in ("family", "run_id", "rank") if c in wide.columns]
    out = wide.select(*keys, F.posexplode(places(F.col("aligned"))).alias("pos", "col"))
    return out.select(*keys, F.col("col").cast("long").alias("col"), F.col("pos").cast("long").alias("pos"))


def collapse(long: DataFrame, keys: tuple[str, ...] = ("family", "run_id", "rank")) -> DataFrame:
    """Rows of text back from residues and gaps."""
    cells = F.array_sort(F.collect_list(F.struct("col", "ch")))
    return long.groupBy(*keys).agg(F.array_join(F.transform(cells, lambda c: c["ch"]), "").alias("aligned"))


def dealign(aligned: Column) -> Column:
    return F.regexp_replace(aligned, f"[^{RESIDUE[1:-1]}]", "")


def finalise(seq: Column, gaps: Column) -> Column:
    """Aligned text from residues and the numbers of gaps before each (the last: after all)."""
    chars = F.split(seq, "")
    pieces = F.transform(gaps, lambda n, i: F.concat(F.repeat(F.lit("-"), n.cast("int")), F.when(i < F.length(seq), F.get(chars, i)).otherwise("")))
    return F.array_join(pieces, "")


def gap_vector(aligned: Column) -> Column:
    """Numbers of gaps before each residue and after the last."""
    return F.transform(F.split(aligned, RESIDUE, -1), lambda s: F.length(s))
