"""Families of a DataFrame through the alignment kernels: one family is one group, in parallel over families."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from seqloom.functions import align as kernel
from seqloom.functions import trees
from seqloom.functions.align import MODES, Options
from seqloom.functions.kernels import infix_distance_many
from seqloom.operators.longform import dealign
from seqloom.shared import dealt
from seqloom.sources import text

WIDE = "family string, run_id int, rank long, name string, aligned string"
#: A family is aligned by one task; a larger one is refused, not cut.
LARGEST = 20_000


def options(mode: str = "default", **changes) -> Options:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    return replace(MODES[mode], **changes)


#: Residues of the families that a task aligns together; a larger family goes alone.
TOGETHER = 1 << 18


def _checked(group: pd.DataFrame, each: int = 1) -> pd.DataFrame:
    if len(group) > LARGEST * each:
        raise ValueError(f"family {group['family'].iloc[0]!r} has {len(group) // each} sequences; at most {LARGEST}")
    return group if group["rank"].is_monotonic_increasing else group.sort_values("rank", kind="stable")


def by_family(rows: DataFrame, run: Callable[[list[pd.DataFrame]], list[pd.DataFrame]], schema: str, *also: str, each: int = 1) -> DataFrame:
    """run over whole families (of the columns `also` as well), several at a time: rows (`each` for a sequence) are dealt out
    by family and sorted, and what a partition's batches cut apart is put together again."""
    keys = ["family", *also]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []  # parts of one family
        last: tuple = ()
        ready: list[pd.DataFrame] = []
        size = 0

        def whole() -> pd.DataFrame:
            got = pd.concat(waiting, ignore_index=True) if len(waiting) > 1 else waiting[0].reset_index(drop=True)
            waiting.clear()
            return _checked(got, each)

        def aligned() -> Iterator[pd.DataFrame]:
            made = run(ready)
            if made:
                yield pd.concat(made, ignore_index=True) if len(made) > 1 else made[0]

        for b in batches:
            if b.empty:
                continue
            named = b[keys].fillna("").to_numpy()
            starts = np.r_[0, np.flatnonzero((named[1:] != named[:-1]).any(1)) + 1, len(b)]
            letters = np.r_[0, np.cumsum(b["seq"].str.len().fillna(0).to_numpy())]
            for at, end in zip(starts[:-1], starts[1:], strict=True):
                if waiting and last != tuple(named[at]):
                    ready.append(whole())
                    if size >= TOGETHER:
                        yield from aligned()
                        ready, size = [], 0
                last = tuple(named[at])
                size += int(letters[end] - letters[at])
                waiting.append(b.iloc[at:end])
        if waiting:
            ready.append(whole())
        if ready:
            yield from aligned()

    return dealt(rows, *keys).sortWithinPartitions(*keys, "rank").mapInPandas(stream, schema)


def align(seqs: DataFrame, mode: str = "default", **changes) -> DataFrame:
    """family, run_id, rank, name, aligned from family, rank, name, seq (aligned input loses its gaps first)."""
    o = options(mode, **changes)

    def run(families: list[pd.DataFrame]) -> list[pd.DataFrame]:
        rows = kernel.align_families([(g["name"].tolist(), g["seq"].tolist()) for g in families], o)
        return [pd.DataFrame({"family": g["family"], "run_id": 0, "rank": g["rank"], "name": g["name"], "aligned": r}) for g, r in zip(families, rows, strict=True)]

    src = seqs.select("family", F.col("rank").cast("long"), F.coalesce("name", F.lit("")).alias("name"), dealign(F.coalesce("seq", F.lit(""))).alias("seq"))
    return by_family(src, run, WIDE)


def align_runs(seqs: DataFrame, runs: int, seed: int = 42) -> DataFrame:
    """The runs of an ensemble as rows with run_id; each (family, run) is aligned for itself."""

    def run(families: list[pd.DataFrame]) -> list[pd.DataFrame]:
        out = []
        for k in sorted({int(g["run_id"].iloc[0]) for g in families}):
            some = [g for g in families if g["run_id"].iloc[0] == k]
            a, b, c, noise = kernel.RUNS[k % len(kernel.RUNS)]
            orders = [sorted(range(len(g)), key=lambda i, g=g: (-len(g["seq"].iloc[i]), g["name"].iloc[i], i)) for g in some]
            own = [[g["seq"].iloc[i] for i in order] for g, order in zip(some, orders, strict=True)]
            scores = [kernel.scores_for(kernel.type_for("", x)).scaled(a, b, c) for x in own]
            grown = trees.guide_trees(own, [seed + k] * len(own), noise)
            jobs = [kernel.Job(x, s, t) for x, s, t in zip(own, scores, grown, strict=True)]
            many = [j for j, x in enumerate(own) if len(x) > 1]
            made = dict(zip(many, kernel.progressive_many([jobs[j] for j in many], MODES["fast"]), strict=True))
            for j, (g, order) in enumerate(zip(some, orders, strict=True)):
                put = dict(zip(order, made.get(j, own[j]), strict=True))
                out.append(pd.DataFrame({"family": g["family"], "run_id": k, "rank": g["rank"], "name": g["name"], "aligned": [put[i] for i in range(len(g))]}))
        return out

    src = seqs.filter(F.length("seq") > 0).select("family", F.col("rank").cast("long"), F.coalesce("name", F.lit("")).alias("name"), "seq", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_id"))
    return by_family(src, run, WIDE, "run_id")


def consensus_from_support(seqs: DataFrame, support: DataFrame, least: int) -> DataFrame:
    """Alignments from a support table (family, i, j, pos_i, pos_j, mask) whose i, j are ranks, at another threshold."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g = _checked(left).reset_index(drop=True)
        names, own = g["name"].tolist(), g["seq"].tolist()
        order = sorted(range(len(g)), key=lambda i: (-len(own[i]), names[i], own[i], i))  # as an ensemble takes them
        place = {g["rank"][i]: k for k, i in enumerate(order)}
        if not set(right["i"]).union(right["j"]) <= set(place):
            raise ValueError(f"support of family {g['family'].iloc[0]!r} names other sequences")
        table = {}
        for i, j, p, q, m in zip(right["i"], right["j"], right["pos_i"], right["pos_j"], right["mask"], strict=True):
            x, y = (place[i], p), (place[j], q)
            (x, p), (y, q) = (x, y) if x < y else (y, x)
            table[x, y, p, q] = int(m)
        put = dict(zip(order, kernel.consensus([own[i] for i in order], table, least), strict=True))
        rows = [put[i] for i in range(len(g))]
        return pd.DataFrame({"family": g["family"], "run_id": 0, "rank": g["rank"], "name": g["name"], "aligned": rows})

    src = seqs.select("family", F.col("rank").cast("long"), "name", "seq")
    return src.groupBy("family").cogroup(support.groupBy("family")).applyInPandas(run, WIDE)


def consensus_of_runs(seqs: DataFrame, made: DataFrame, runs: int, least: int) -> DataFrame:
    """consensus_from_support of the runs (align_runs of seqs): what they have in common follows from their rows, family by
    family, without a table of pairs."""

    def run(families: list[pd.DataFrame]) -> list[pd.DataFrame]:
        out = []
        for g in families:
            own = g[g["run_id"] == -1].reset_index(drop=True)
            names, texts = own["name"].tolist(), own["seq"].tolist()
            order = sorted(range(len(own)), key=lambda i: (-len(texts[i]), names[i], texts[i], i))  # as an ensemble takes them
            order = [i for i in order if texts[i]]
            of = {k: dict(zip(x["rank"], x["seq"], strict=True)) for k, x in g.groupby("run_id")}
            rows = [[of[k][own["rank"][i]] for i in order] if order else [] for k in range(runs)]
            made = kernel.consensus_of_runs([texts[i] for i in order], rows, least) if order else []
            put = dict(zip(order, made, strict=True))
            out.append(pd.DataFrame({"family": own["family"], "run_id": 0, "rank": own["rank"], "name": own["name"], "aligned": [put.get(i, "-" * len(made[0]) if made else "") for i in range(len(own))]}))
        return out

    src = seqs.select("family", F.col("rank").cast("long"), "name", "seq", F.lit(-1).alias("run_id"))
    return by_family(src.unionByName(made.select("family", "rank", "name", F.col("aligned").alias("seq"), "run_id")), run, WIDE, each=runs + 1)


def _grown(g: pd.DataFrame) -> list[str]:
    """A family's sequences in canonical order."""
    return [s for _, s in sorted(zip(g["name"], g["seq"], strict=True), key=lambda x: (-len(x[1]), x[0]))]


def guide_trees(seqs: DataFrame) -> DataFrame:
    """family, a, b, c: merges by places in canonical order; c is the new node."""

    def run(families: list[pd.DataFrame]) -> list[pd.DataFrame]:
        grown = trees.guide_trees([_grown(g) for g in families], [0] * len(families))
        rows = [(g["family"].iloc[0], *m) for g, tree in zip(families, grown, strict=True) for m in tree]
        return [pd.DataFrame(rows, columns=["family", "a", "b", "c"])]

    return by_family(seqs.select("family", "rank", "name", "seq"), run, "family string, a int, b int, c int")


def tree_weights(seqs: DataFrame) -> DataFrame:
    """family, leaf, weight of the guide trees: trees.leaf_weights where a family's tree is at hand; none for a single sequence."""

    def run(families: list[pd.DataFrame]) -> list[pd.DataFrame]:
        grown = trees.guide_trees([_grown(g) for g in families], [0] * len(families))
        rows = [(g["family"].iloc[0], i, w) for g, tree in zip(families, grown, strict=True) if tree for i, w in enumerate(trees.leaf_weights(tree))]
        return [pd.DataFrame(rows, columns=["family", "leaf", "weight"])]

    return by_family(seqs.select("family", "rank", "name", "seq"), run, "family string, leaf int, weight double")


def edit_distance_infix(text_col: str, pattern_col: str) -> Column:
    """Least edit distance between the pattern and any substring of the text."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(infix_distance_many(a.fillna("").tolist(), b.fillna("").tolist()))

    return F.pandas_udf(run, IntegerType())(text_col, pattern_col)


def sequence_distance(a_col: str, b_col: str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(trees.pair_distances(list(zip(a.fillna(""), b.fillna(""), strict=True))))

    return F.pandas_udf(run, DoubleType())(a_col, b_col)


def anchor_distances(seqs: DataFrame, anchors: DataFrame) -> DataFrame:
    """family, rank, anchor, distance: every sequence against its family's anchors (32 at most)."""
    a = anchors.select("family", F.col("place").alias("anchor"), F.col("seq").alias("anchor_seq"))
    return seqs.join(a, "family").select("family", "rank", "anchor", sequence_distance("seq", "anchor_seq").alias("distance"))


def generate(spark: SparkSession, families: int, n: int, length: int, seed: int = 42, dna: bool = False) -> DataFrame:
    """family, rank, name, seq: synthetic families, one for each seed from seed on."""

    def run(batches):
        for b in batches:
            for k in b["id"].tolist():
                rows = kernel.generate_family(n, length, seed + int(k), dna)
                yield pd.DataFrame({"family": f"g{k}", "rank": range(len(rows)), "name": [f"seq{i}" for i in range(len(rows))], "seq": rows})

    return spark.range(families).mapInPandas(run, "family string, rank long, name string, seq string")


def generate_true(spark: SparkSession, families: int, n: int, length: int, seed: int = 42, dna: bool = False) -> DataFrame:
    """family, rank, name, aligned: synthetic families with their true alignments."""

    def run(batches):
        for b in batches:
            for k in b["id"].tolist():
                rows = kernel.generate_alignment(n, length, seed + int(k), dna)
                yield pd.DataFrame({"family": f"g{k}", "rank": range(len(rows)), "name": [f"seq{i}" for i in range(len(rows))], "aligned": rows})

    return spark.range(families).mapInPandas(run, "family string, rank long, name string, aligned string")


def mean_distances(distances: DataFrame, seqs: DataFrame) -> DataFrame:
    """family, rank, share: each sequence's mean distance to the anchors (anchor_distances), to its length."""
    n = seqs.select("family", "rank", F.length("seq").alias("n"))
    return distances.join(n, ["family", "rank"]).groupBy("family", "rank").agg((F.avg("distance") / F.greatest(F.max("n"), F.lit(1))).alias("share"))


def align_path(spark: SparkSession, path: str, mode: str = "default", **changes) -> DataFrame:
    """FASTA files under a path, a family each."""
    return align(text.fasta(text.files(spark, path), strict=True).withColumnRenamed("path", "family"), mode, **changes)


def provenance(mode: str, **changes) -> dict:
    import platform

    import pyspark

    return {"mode": mode, "options": asdict(options(mode, **changes)), "python": platform.python_version(), "spark": pyspark.__version__}
