"""Evaluation of alignment methods: work lists, cases with their scores, sweeps of options, calibration, search sets."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import align as kernel
from seqloom.operators import calibration, compare, pairs
from seqloom.operators.align import align_runs, by_family, options
from seqloom.operators.longform import dealign

#: Named methods: a mode, changes to it, and a bound for masking by confidence (None: no masking).
METHODS: dict[str, tuple[str, dict, float | None]] = {
    "fast": ("fast", {}, None),
    "anchored": ("default", {}, None),
    "ensemble3": ("precise", {}, None),
    "refined": ("fast", {"refine": "confident"}, None),
}


def work_list(cases: DataFrame, methods: dict[str, bool], refine: list[str]) -> DataFrame:
    """cases with method, refine and turn: each method of ours in every mode of refinement, an outside one (True) once."""
    rows = [(m, r) for m, outside in methods.items() for r in (["none"] if outside else refine)]
    each = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(m).alias("method"), F.lit(r).alias("refine")) for i, (m, r) in enumerate(rows)])
    return cases.select("*", F.explode(each).alias("w")).select(*cases.columns, "w.method", "w.refine", "w.turn")


def run_cases(seqs: DataFrame, method: str, align: Callable[[list[str], list[str]], list[str]] | None = None) -> DataFrame:
    """family, rank, name, aligned, method, seconds, error: each family by itself, timed; a failure gives its error and no rows of text.

    align: (names, seqs) -> rows, in place of a method's own options, for methods from outside.
    """
    mode, changes, _ = METHODS.get(method, ("fast", {}, None))
    o = options(mode, **changes)
    one = align or (lambda names, rows: kernel.align_family(names, rows, o))

    def run(families: list[pd.DataFrame]) -> list[pd.DataFrame]:
        out = []
        for g in families:
            began, error, rows = time.perf_counter(), None, [None] * len(g)
            try:
                rows = one(g["name"].tolist(), g["seq"].tolist())
            except Exception as e:  # one case must not end the others; its error is its result
                error = f"{type(e).__name__}: {e}"
            out.append(pd.DataFrame({"family": g["family"], "rank": g["rank"], "name": g["name"], "aligned": rows, "method": method, "seconds": time.perf_counter() - began, "error": error}))
        return out

    src = seqs.select("family", F.col("rank").cast("long"), "name", "seq")
    return by_family(src, run, "family string, rank long, name string, aligned string, method string, seconds double, error string")


def scored(made: DataFrame, ref: DataFrame) -> DataFrame:
    """family, method, sp, recall, precision, f1, tc, seconds, error; scores of failed cases are 0."""
    key = F.concat_ws("\u0001", "method", "family")
    good = made.filter("error IS NULL").select(key.alias("family"), "rank", "name", "aligned")
    whole = made.filter("error IS NULL").select("method", "family").distinct()
    truth = ref.join(whole, "family").select(key.alias("family"), "rank", "name", "aligned")
    got = compare.detailed(truth, good).join(compare.sum_of_pairs(truth, good), "family")
    cases = made.groupBy("method", "family").agg(F.max("seconds").alias("seconds"), F.max("error").alias("error")).withColumn("key", key)
    out = cases.join(got.withColumnRenamed("family", "key"), "key", "left")
    return out.select("family", "method", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sp", "recall", "precision", "f1", "tc")], "seconds", "error")


def evaluate(seqs: DataFrame, ref: DataFrame, methods: list[str]) -> DataFrame:
    """Scores of every family by every method: the accuracy pipeline, and with many methods a sweep of options."""
    made = run_cases(seqs, methods[0])
    for m in methods[1:]:
        made = made.unionByName(run_cases(seqs, m))
    return scored(made, ref)


def sweep(seqs: DataFrame, ref: DataFrame, methods: list[str], category: DataFrame) -> DataFrame:
    """method, dataset (null: all), means over families; category: family, dataset."""
    return category_table(evaluate(seqs, ref, methods).join(category, "family"))


def category_table(results: DataFrame) -> DataFrame:
    """method, dataset (null: all), n, mean recall, precision, f1, tc of results without an error."""
    means = [F.avg(c).alias(c) for c in ("recall", "precision", "f1", "tc")]
    return results.filter("error IS NULL").rollup("method", "dataset").agg(F.count("*").alias("n"), *means).filter("method IS NOT NULL")


def accuracy(test: DataFrame, true: DataFrame) -> DataFrame:
    """family, recall, precision, f1, tc of a test alignment over all columns; null for a family that the test does not have."""
    got = compare.detailed(true, test).select("family", "recall", "precision", "f1", "tc")
    return true.select("family").distinct().join(got, "family", "left")


def masked(wide: DataFrame, runs: DataFrame, n_runs: int, threshold: float) -> DataFrame:
    """Rows of run 0 of an ensemble without the columns whose confidence is under the threshold."""
    return pairs.confidence_mask(wide, pairs.column_confidences(runs, 0, n_runs), threshold)


def with_external(scores: DataFrame, outside: DataFrame) -> DataFrame:
    """Scores of ours and, for families that we have, of outside tools (family, method, ...)."""
    known = scores.select("family").distinct()
    return scores.unionByName(outside.join(known, "family", "left_semi"), allowMissingColumns=True)


def joined_scores(alignments: DataFrame, scores: DataFrame, column: str = "score") -> DataFrame:
    """alignments with a score by family and method; NaN where there is none."""
    return alignments.join(scores.select("family", "method", column), ["family", "method"], "left").withColumn(column, F.coalesce(column, F.lit(float("nan"))))


def calibration_cases(seqs: DataFrame, true: DataFrame, runs: int = 3) -> DataFrame:
    """method, family, col, predicted, actual: confidence of each column of the first run against its correctness."""
    made = align_runs(seqs, runs)
    both = made.unionByName(true.withColumn("run_id", F.lit(runs)).select(*made.columns))
    return pairs.column_cases(both, 0, runs, runs).select(F.lit(f"runs{runs}").alias("method"), "family", "col", "predicted", "actual")


def calibration_report(cases: DataFrame, bins: int = 10) -> DataFrame:
    """method, brier, ece, from one pass over the cases."""
    by_bin = cases.groupBy("method", calibration.bin_of(bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("predicted") - F.col("actual"), F.lit(2))).alias("squares"), F.abs(F.avg("predicted") - F.avg("actual")).alias("off"))
    return by_bin.groupBy("method").agg((F.sum("squares") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.col("off")) / F.sum("n")).alias("ece"))


def search_set(families: DataFrame) -> DataFrame:
    """family, name, seq: all families without gaps as one set, each name led by its family and two underscores."""
    return families.select("family", F.concat_ws("__", "family", "name").alias("name"), dealign(F.col("aligned")).alias("seq"))


def hits_of(families: DataFrame, found: DataFrame) -> DataFrame:
    """As calibration.hit_sets: names found by a family's search against those of the set that belong to it."""
    members = search_set(families).select("family", "name")
    return calibration.hit_sets(found.select("family", "name"), members)


def selection_cases(sites: DataFrame, classes: DataFrame) -> DataFrame:
    """method, predicted, actual by site: a site test's posterior against the simulated class; a site without one counts as 0."""
    return sites.join(classes, ["family", "site"], "left").select("method", F.col("posterior").alias("predicted"), F.coalesce("selected", F.lit(0)).alias("actual"))


def tree_summary(cases: DataFrame) -> DataFrame:
    """method, n, mean and population deviation of nrf, and of sp where it is known."""
    sp = F.when(F.col("sp") >= 0, F.col("sp"))
    return cases.filter("error IS NULL").groupBy("method").agg(F.count("*").alias("n"), F.avg("nrf").alias("mean_nrf"), F.stddev_pop("nrf").alias("std_nrf"), F.avg(sp).alias("mean_sp"), F.stddev_pop(sp).alias("std_sp"))


def families_in(spark: SparkSession, folder: str, mode: str = "fast") -> DataFrame:
    """Alignments of all FASTA files of a folder, a family each, with their time: family, n, width, seconds, error."""
    from seqloom.sources import text

    seqs = text.fasta(text.files(spark, folder)).withColumnRenamed("path", "family")
    made = run_cases(seqs.withColumn("rank", F.col("rank").cast("long")), mode if mode in METHODS else "fast")
    return made.groupBy("family").agg(F.count("*").alias("n"), F.max(F.length("aligned")).alias("width"), F.max("seconds").alias("seconds"), F.max("error").alias("error"))


def has_gaps(ref: DataFrame) -> DataFrame:
    """Rows of the references that hold a gap; one without any is aligned trivially and is no case."""
    some = ref.filter(F.contains("aligned", F.lit("-"))).select("family").distinct()
    return ref.join(some, "family", "left_semi")


