"""Column and row statistics of alignments; counts by column and letter in place of pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import cells
from seqloom.operators.families import by_family


def alignment_stats(wide: DataFrame) -> DataFrame:
    """family, length, n_sequences, gap_fraction, conservation, identity.

    Identity is pooled over all pairs: in a column, n equal letters are n (n - 1) / 2 matches, so no pair is made.
    """

    def run(b: cells.Block) -> dict:
        c = cells.letter_counts(b)
        of = c.family()
        residue = c.letter != ord("-")
        rows, letters, present, same = (c.per_column(x) for x in (c.n, residue.astype(np.int64), np.where(residue, c.n, 0), np.where(residue, cells.pairs_of(c.n), 0)))
        most = np.zeros(b.n, np.int64)
        np.maximum.at(most, of, rows)
        length, gaps, total, whole, met, both = (cells.per(of, b.n, x) for x in (np.ones(len(of), np.int64), rows - present, rows, (letters == 1).astype(np.int64), same, cells.pairs_of(present)))
        known = length > 0
        share = lambda x, y: x[known] / np.maximum(y[known], 1)
        return {"family": b.named(np.flatnonzero(known)), "length": length[known], "n_sequences": most[known], "gap_fraction": share(gaps, total), "conservation": share(whole, length), "identity": share(met, both)}

    return by_family(wide.select("family", "rank", "aligned"), run, "family string, length bigint, n_sequences bigint, gap_fraction double, conservation double, identity double")


def column_consensus(wide: DataFrame, threshold: float = 0.5, unknown: str | None = None) -> DataFrame:
    """family, consensus: each column's commonest letter if its share of letters reaches the threshold.

    Ties go to the letter met first in row order; a column of gaps gives '-'.  Below the threshold stands `unknown`, or
    else N in a family whose letters are all nucleotides' and X in others.
    """
    nucleotides = [ord(c) for c in "ATCGUN-"]

    def run(b: cells.Block) -> dict:
        c = cells.letter_counts(b, ranks=True)
        residue = c.letter != ord("-")
        present = c.per_column(np.where(residue, c.n, 0))
        order = np.lexsort((c.first, -np.where(residue, c.n, -1), c.at))  # gaps last in each column
        top = order[c.begins]
        letter = np.where(present == 0, ord("-"), np.where(c.n[top] / np.maximum(present, 1) >= threshold, c.letter[top], 0))
        other = np.bincount(c.at[~np.isin(c.letter, nucleotides)] // c.width, minlength=b.n) > 0
        ends = np.searchsorted(c.columns, np.arange(b.n + 1) * c.width)
        text = letter.astype("<u4").tobytes().decode("utf-32-le")
        known = [k for k in range(b.n) if ends[k] < ends[k + 1]]
        stand = lambda k: unknown if unknown is not None else "X" if other[k] else "N"
        return {"family": b.named(np.array(known, np.int64)), "consensus": [text[ends[k] : ends[k + 1]].replace("\0", stand(k)) for k in known]}

    return by_family(wide.select("family", "rank", "aligned"), run, "family string, consensus string")


def gap_shares(wide: DataFrame) -> DataFrame:
    """family, shares: each column's share of gaps, a family in one row."""

    def run(b: cells.Block) -> dict:
        c = cells.letter_counts(b)
        share = c.per_column(np.where(c.letter == ord("-"), c.n, 0)) / c.per_column(c.n)
        ends = np.searchsorted(c.columns, np.arange(b.n + 1) * c.width).astype(np.int32)
        return {"family": b.families, "shares": pa.ListArray.from_arrays(pa.array(ends), pa.array(share, pa.float64()))}

    return by_family(wide.select("family", "rank", "aligned"), run, "family string, shares array<double>").filter("size(shares) > 0")


def remove_gap_columns(wide: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Rows without the columns whose share of gaps reaches the threshold.

    The kept columns of a family are one small row (an array), joined back to its rows of text.
    """
    kept = F.filter(F.transform("shares", lambda g, i: F.when(g < threshold, i)), lambda i: i.isNotNull())
    return keep_columns(wide, gap_shares(wide).select("family", kept.alias("kept")))


def keep_columns(wide: DataFrame, kept: DataFrame) -> DataFrame:
    """kept: family, kept (sorted column numbers)."""
    chars = F.split("aligned", "")
    text = F.array_join(F.transform("kept", lambda c: F.get(chars, c.cast("int"))), "")
    return wide.join(kept, "family").withColumn("aligned", text).drop("kept")


def trim(wide: DataFrame, start: int, end: int) -> DataFrame:
    """Columns [start, end); a negative start or end counts from the right; an empty range is an error."""
    if start < 0:
        begin = F.greatest(F.length("aligned") + start, F.lit(0))
    else:
        begin = F.lit(start)
    stop = F.when(F.lit(end) < 0, F.length("aligned") + end).otherwise(F.least(F.lit(end), F.length("aligned")))
    none = F.raise_error(F.concat(F.lit(f"no columns from {start} to {end} in a row of "), F.length("aligned").cast("string"))).cast("string")
    return wide.withColumn("aligned", F.when(begin >= stop, none).otherwise(F.col("aligned").substr(begin + 1, stop - begin)))


#: Rows of a family's block; a larger family is joined by pairs of blocks, each a key of its own.
BLOCK_ROWS = 512


def row_pairs(wide: DataFrame) -> DataFrame:
    """family, i, j, x, y: ranks i < j and texts of every two rows of a family.

    A row goes to every pair of blocks that holds its own, so no family meets in one task whole.
    """
    blocks = wide.groupBy("family").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = wide.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("rank"), F.col("blocks")).cast("int"))
    dealt = own.select("family", "rank", "aligned", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    a = dealt.filter("own = p").select("family", "p", "q", F.col("rank").alias("r"), F.col("aligned").alias("x"))
    b = dealt.filter("own = q").select("family", "p", "q", F.col("rank").alias("s"), F.col("aligned").alias("y"))
    met = a.join(b, ["family", "p", "q"]).filter("p < q OR r < s")
    first = F.col("r") < F.col("s")
    return met.select("family", F.least("r", "s").alias("i"), F.greatest("r", "s").alias("j"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("y"))


def pairwise_identity(wide: DataFrame) -> DataFrame:
    """family, i, j, identity for rows i < j: matches over columns where both have a letter, 0 without any."""

    def run(b: cells.Block) -> Iterator[dict]:
        some, size = [], 0
        for got in cells.identities(b):
            some.append(got)
            size += len(got[1])
            if size >= 1 << 16:
                yield _pairs(b, some)
                some, size = [], 0
        if some:
            yield _pairs(b, some)

    rank = wide.schema["rank"].dataType.simpleString()
    return by_family(wide.select("family", "rank", "aligned"), run, f"family string, i {rank}, j {rank}, identity double")


def _pairs(b: cells.Block, some: list[tuple]) -> dict:
    first = np.repeat([x[0] for x in some], [len(x[1]) for x in some])
    i, j, identity = (np.concatenate([x[k] for x in some]) for k in (1, 2, 3))
    return {"family": b.named(b.of[first]), "i": i, "j": j, "identity": identity}


def identity_matrix(wide: DataFrame) -> DataFrame:
    """family, i, j, identity: the whole matrix, with ones on the diagonal."""
    place = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    both = pairwise_identity(wide).select("family", F.explode(F.array(place("i", "j"), place("j", "i"))).alias("p"), "identity").select("family", "p.i", "p.j", "identity")
    own = wide.select("family", F.col("rank").alias("i"), F.col("rank").alias("j"), F.lit(1.0).alias("identity"))
    return both.union(own)


def gap_runs(wide: DataFrame) -> DataFrame:
    """family, rank, start, length, terminal: runs of gaps; a gap's column less its number among the row's gaps names its run."""
    gaps = F.filter(F.transform(F.split("aligned", ""), lambda c, i: F.when(c == "-", i)), lambda i: i.isNotNull())
    each = wide.filter(F.length("aligned") > 0).select("family", "rank", F.length("aligned").alias("w"), F.posexplode(gaps).alias("k", "col"))
    runs = each.groupBy("family", "rank", (F.col("col") - F.col("k")).alias("run")).agg(F.min("col").alias("start"), F.count("*").alias("length"), F.max("w").alias("w"))
    return runs.select("family", "rank", "start", "length", ((F.col("start") == 0) | (F.col("start") + F.col("length") == F.col("w"))).alias("terminal"))


def identity_distance_mean(wide: DataFrame) -> DataFrame:
    """family, distance: mean of 1 - identity over pairs of rows, 1 for a pair without common columns."""

    def run(b: cells.Block) -> dict:
        n, total = np.zeros(b.n, np.int64), np.zeros(b.n)
        for first, i, _, identity in cells.identities(b):
            n[b.of[first]] += len(i)
            total[b.of[first]] += (1 - identity).sum()
        known = n > 0
        return {"family": b.named(np.flatnonzero(known)), "distance": total[known] / n[known]}

    return by_family(wide.select("family", "rank", "aligned"), run, "family string, distance double")


def gap_stats(wide: DataFrame) -> DataFrame:
    """family: mean ungapped length, expansion, gap fraction, gap runs, mean run, terminal and internal gaps, gappy columns."""
    text = F.col("aligned")
    blocks = F.regexp_extract_all(text, F.lit("-+"), F.lit(0))
    body = F.length(F.regexp_replace(text, "^-+|-+$", ""))
    rows = wide.select("family", F.length(text).alias("w"), F.length(F.regexp_replace(text, "-", "")).alias("n"), F.size(blocks).alias("b"), (F.length(text) - body).alias("t"))
    by_row = rows.groupBy("family").agg(
        F.avg("n").alias("mean_length"), (F.max("w") / F.avg("n")).alias("expansion"), (F.sum(F.col("w") - F.col("n")) / F.sum("w")).alias("gap_fraction"),
        F.sum("b").alias("gap_blocks"), F.coalesce(F.sum(F.col("w") - F.col("n")) / F.nullif(F.sum("b"), F.lit(0)), F.lit(0.0)).alias("mean_block"),
        F.sum("t").alias("terminal_gaps"), F.sum(F.col("w") - F.col("n") - F.col("t")).alias("internal_gaps"),
    )
    gappy = gap_shares(wide).select("family", F.size(F.filter("shares", lambda g: g > 0.5)).cast("long").alias("gappy_columns"))
    return by_row.join(gappy, "family")


def letter_histogram(seqs: DataFrame) -> DataFrame:
    return seqs.select("family", F.explode(F.split("seq", "")).alias("ch")).filter("ch <> ''").groupBy("family", "ch").agg(F.count("*").alias("n"))


# fixed values: letters that speak for nucleotides and for proteins, and their shares
DNA_LETTERS, PROTEIN_LETTERS = "acgtunACGTUN", "acdefghiklmnpqrstvwyACDEFGHIKLMNPQRSTVWY"
DNA_SHARES, PROTEIN_SHARES = (0.9999 / 12, 0.0001 / 116), (0.9999 / 40, 0.0001 / 88)


def detect_alphabet(histogram: DataFrame) -> DataFrame:
    """family, kind: the likelier of two letter models; 'unknown' on a tie."""
    log = lambda letters, p: F.sum(F.col("n") * F.when(F.instr(F.lit(letters), F.col("ch")) > 0, F.log(F.lit(p[0]))).otherwise(F.log(F.lit(p[1]))))
    scored = histogram.groupBy("family").agg(log(DNA_LETTERS, DNA_SHARES).alias("d"), log(PROTEIN_LETTERS, PROTEIN_SHARES).alias("p"))
    return scored.select("family", F.when(F.col("d") > F.col("p"), "dna").when(F.col("p") > F.col("d"), "protein").otherwise("unknown").alias("kind"))


def detect_aligned(wide: DataFrame) -> DataFrame:
    """family, status: by whether rows hold gaps and are of one length."""
    rows = wide.groupBy("family").agg(F.min(F.length("aligned")).alias("a"), F.max(F.length("aligned")).alias("b"), F.sum(F.length(F.regexp_replace("aligned", "[A-Za-z]", ""))).alias("gaps"))
    return rows.select("family", F.when(F.col("gaps") > 0, F.when(F.col("a") == F.col("b"), "aligned").otherwise("unknown")).otherwise(F.when(F.col("a") == F.col("b"), "unknown").otherwise("unaligned")).alias("status"))


def gcg_checksum(text: str | Column = "seq"):
    """Sum of letter codes times their place modulo 57, modulo 10000."""
    text = F.col(text) if isinstance(text, str) else text
    codes = F.transform(F.split(F.upper(text), ""), lambda c, i: F.ascii(c) * (i % 57 + 1))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a + b) % 10000)


def edge_median(tree: DataFrame) -> DataFrame:
    return tree.groupBy("family").agg(F.median("confidence").alias("threshold"))


def edge_medians(told: DataFrame) -> DataFrame:
    """edge_median of pairs.column_confidences, where a family's confidences are one array."""
    a, n = F.array_sort("confidences"), F.size("confidences")
    middle = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    return told.select("family", middle.alias("threshold"))


def residue_index_window(long: DataFrame) -> DataFrame:
    """The residue index by a running count, for long input that has no row of text to count in."""
    w = Window.partitionBy("family", "run_id", "rank").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("pos", F.when(F.col("ch") != "-", F.sum(F.when(F.col("ch") != "-", 1).otherwise(0)).over(w) - 1))


def quick_stats(wide: DataFrame) -> DataFrame:
    """family, gap_fraction, opens (gap runs a row), ratio (width over mean residues)."""
    n = F.length(F.translate("aligned", "-", ""))
    return wide.groupBy("family").agg(
        (1 - F.sum(n) / F.sum(F.length("aligned"))).alias("gap_fraction"), F.avg(F.size(F.regexp_extract_all("aligned", F.lit("-+"), F.lit(0)))).alias("opens"), (F.max(F.length("aligned")) / F.avg(n)).alias("ratio"),
    )
