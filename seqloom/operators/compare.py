"""One alignment against another of the same rows: pairs, sum of pairs, total columns.

A pair of residues is aligned in both alignments when its rows share the column of the one and of the other, so common
pairs are counts of rows by both columns; no table of pairs is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import cells
from seqloom.operators.columns import gcg_checksum
from seqloom.operators.families import both, by_family


def by_name(ref: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ranks that match them by name: the order of names, of equal ones by checksum of their residues, highest
    first.  A row without its like on the other side is an error.

    Rows of both are dealt out once, by family; what lies side by side there needs no join.
    """
    one = lambda x, k: x.select("family", F.col("rank").cast("long").alias("rank"), "name", "aligned", F.lit(k).alias("side"))
    x = one(ref, 0).unionByName(one(test, 1)).withColumn("chk", gcg_checksum(F.regexp_replace("aligned", "[^A-Za-z]", ""))).repartition("family")
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy("family", "side", "name").orderBy(F.col("chk").desc(), "rank")))
    x = x.withColumn("rank", (F.row_number().over(Window.partitionBy("family", "side").orderBy("name", "turn")) - 1).cast("long"))
    x = x.withColumn("sides", F.count("*").over(Window.partitionBy("family", "name", "turn")))
    other = F.when(F.col("side") == 0, "test").otherwise("reference")
    told = F.concat(F.lit("sequence "), "name", F.lit(" of family "), "family", F.lit(" is not in the "), other)
    x = x.withColumn("aligned", F.when(F.col("sides") < 2, F.raise_error(told).cast("string")).otherwise(F.col("aligned")))
    side = lambda k: x.filter(F.col("side") == k).select("family", "rank", "name", "aligned")
    return side(0), side(1)


def _text_of_mask(mask: DataFrame, ref: DataFrame) -> DataFrame:
    """family, aligned: a mask as text, '1' for a scored column; one that has not a row for each column of the reference is an error."""
    width = ref.groupBy("family").agg(F.max(F.length("aligned")).alias("width"))
    held = mask.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("col", (F.col("mask") == 1).alias("on")))).alias("held"))
    told = F.concat(F.lit("mask of family "), "family", F.lit(" has "), F.size("held").cast("string"), F.lit(" columns, its alignment "), F.col("width").cast("string"))
    fits = (F.size("held") == F.col("width")) & ~F.exists(F.transform("held", lambda c, i: c["col"] != i), lambda x: x)
    marks = F.array_join(F.transform("held", lambda c: F.when(c["on"], "1").otherwise("0")), "")
    return held.join(width, "family").select("family", F.when(fits, marks).otherwise(F.raise_error(told).cast("string")).alias("aligned"))


def detailed(ref: DataFrame, test: DataFrame, most_gaps: float = -1.0, mask: DataFrame | None = None) -> DataFrame:
    """family, recall, precision, f1, tc, ref_pairs, test_pairs, common.

    Recall and tc look at scored columns (of a mask, or within the bound of gaps); precision at all.  A mask has a row
    for each column of the reference, else it is an error.
    """
    rows, masked = both(ref, test), mask is not None
    if masked:  # goes along as a row of text before the others
        rank = rows.schema["rank"].dataType
        rows = rows.unionByName(_text_of_mask(mask, ref).select("family", F.lit(-1).cast(rank).alias("rank"), F.lit(2).alias("run_id"), "aligned"))

    def run(b: cells.Block) -> dict:
        run_id = b.column("run_id")
        r = cells.residues(b, 2)
        w = max(r.width, 1 + int(b.texts()[2].max(initial=0)))
        letters, row, col = b.texts()
        at = b.of[row] * w + col
        scored = np.zeros(b.n * w, bool)
        if masked:
            on = (run_id[row] == 2) & (letters == ord("1"))
            scored[at[on]] = True
        elif most_gaps < 0:
            scored[:] = True
        else:
            own = run_id[row] == 0
            n = np.bincount(at[own], minlength=b.n * w)
            gaps = np.bincount(at[own & ~cells.letter(letters)], minlength=b.n * w)
            scored = gaps / np.maximum(n, 1) <= most_gaps
        is_scored = lambda keys: scored[keys // r.width * w + keys % r.width]
        total = {}
        for name, k in (("ref", 0), ("test", 1)):
            keys, n = cells.groups(r.family[r.at[k] >= 0] * r.width + r.at[k][r.at[k] >= 0], b.n * r.width)
            if k == 0:
                n = np.where(is_scored(keys), n, 0)
            total[name] = cells.per(keys // r.width, b.n, cells.pairs_of(n))
        here = np.flatnonzero((r.at[0] >= 0) & (r.at[1] >= 0))
        cell, n = cells.groups((r.family[here] * r.width + r.at[0][here]) * r.width + r.at[1][here], b.n * r.width**2)
        of = cell // r.width**2
        every, common = (cells.per(of, b.n, cells.pairs_of(x)) for x in (n, np.where(is_scored(cell // r.width), n, 0)))
        keys, k, spread = cells.spreads(r, 0, 1, b.n)
        counted = is_scored(keys) & (k >= 2)
        cols, whole = (cells.per(keys[x] // r.width, b.n) for x in (counted, counted & (spread == 1)))
        known = (np.bincount(r.family[r.at[0] >= 0], minlength=b.n) > 0) & (np.bincount(b.of[run_id == 1], minlength=b.n) > 0)
        share = lambda x, y: x[known] / np.maximum(y[known], 1)
        return {"family": b.named(np.flatnonzero(known)), "recall": share(common, total["ref"]), "precision": share(every, total["test"]), "tc": share(whole, cols), "ref_pairs": total["ref"][known], "test_pairs": total["test"][known], "common": common[known]}

    out = by_family(rows, run, "family string, recall double, precision double, tc double, ref_pairs bigint, test_pairs bigint, common bigint")
    total = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("recall") * F.col("precision") / total).otherwise(0.0))


def sum_of_pairs(ref: DataFrame, test: DataFrame) -> DataFrame:
    """family, sp: of 100, the share of (residue, other row) cases of the reference that the test repeats.

    A family of one row has no cases and a null.  A residue faces either a residue of the other row or a gap.  Rows with gaps against a residue in both alignments
    are all rows less those present in its one column or the other.
    """

    def run(b: cells.Block) -> dict:
        same, every = cells.facing(cells.residues(b, 2), b.n)
        known = np.bincount(b.of[b.column("run_id") == 0], minlength=b.n) > 0
        share = 100 * same / np.maximum(every, 1)
        return {"family": b.named(np.flatnonzero(known)), "sp": pa.array(share[known], mask=every[known] == 0)}

    return by_family(both(ref, test), run, "family string, sp double")


def column_correctness(test: DataFrame, true: DataFrame) -> DataFrame:
    """family, col, correct: 1 where a test column's residues all come from one true column (or it holds at most one)."""

    def run(b: cells.Block) -> dict:
        letters, row, col = b.texts()
        own = b.column("run_id")[row] == 0
        w = int(col.max(initial=0)) + 1
        at = b.of[row[own]] * w + col[own]
        keys, at = np.unique(at, return_inverse=True)
        n = cells.per(at[cells.letter(letters[own])], len(keys))
        r = cells.residues(b, 2)
        known, _, spread = cells.spreads(r, 0, 1, b.n)
        d = np.zeros(len(keys), np.int64)
        d[np.searchsorted(keys, known // r.width * w + known % r.width)] = spread
        return {"family": b.named(keys // w), "col": keys % w, "correct": ((n <= 1) | (d == 1)).astype(np.int32)}

    return by_family(both(test, true), run, "family string, col bigint, correct int")
