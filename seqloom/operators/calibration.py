"""Calibration and classification measures, roll-ups of benchmark results, paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brier(cases: DataFrame) -> DataFrame:
    """method, brier: mean of (predicted - actual)^2, 0 without cases."""
    return cases.groupBy("method").agg(F.coalesce(F.avg(F.pow(F.col("predicted") - F.col("actual"), F.lit(2))), F.lit(0.0)).alias("brier"))


def bin_of(bins: int):
    return F.least(F.floor(F.col("predicted") * bins), F.lit(bins - 1)).cast("int")


def expected_calibration_error(cases: DataFrame, bins: int = 10) -> DataFrame:
    by_bin = cases.groupBy("method", bin_of(bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("predicted") - F.avg("actual")).alias("off"))
    return by_bin.groupBy("method").agg((F.sum(F.col("n") * F.col("off")) / F.sum("n")).alias("ece"))


def calibration_curve(cases: DataFrame, bins: int = 10) -> DataFrame:
    """method, bin, centre, fraction (null for an empty bin), n: every bin has a row."""
    spine = cases.select("method").distinct().select("method", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    got = cases.groupBy("method", bin_of(bins).alias("bin")).agg(F.avg("actual").alias("fraction"), F.count("*").alias("n"))
    return spine.join(got, ["method", "bin"], "left").select("method", "bin", ((F.col("bin") + 0.5) / bins).alias("centre"), "fraction", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def confusion(cases: DataFrame, threshold: float = 0.9) -> DataFrame:
    """method, tp, fp, fn, tn, precision, recall, f1 of predicted >= threshold against actual."""
    told, true = F.col("predicted") >= threshold, F.col("actual") == 1
    n = lambda c, name: F.count_if(c).alias(name)
    out = cases.groupBy("method").agg(n(told & true, "tp"), n(told & ~true, "fp"), n(~told & true, "fn"), n(~told & ~true, "tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def hit_sets(found: DataFrame, members: DataFrame) -> DataFrame:
    """family, tp, fp, fn, sensitivity, precision of found names against a family's members, as sets."""
    a, b = found.select("family", "name").distinct().withColumn("f", F.lit(1)), members.select("family", "name").distinct().withColumn("m", F.lit(1))
    both = a.join(b, ["family", "name"], "full")
    out = both.groupBy("family").agg(F.count_if(F.col("f").isNotNull() & F.col("m").isNotNull()).alias("tp"), F.count_if(F.col("m").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.withColumn("sensitivity", share(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp")))


def method_rollup(results: DataFrame) -> DataFrame:
    """method, dataset (null: all), n, mean score and time; scores under 0 stand for failures and are left out."""
    keep = F.when(F.col("score") >= 0, F.col("score"))
    return results.rollup("method", "dataset").agg(F.count("*").alias("n"), F.avg(keep).alias("score"), F.avg("seconds").alias("seconds")).filter("method IS NOT NULL")


def runner_summary(results: DataFrame) -> DataFrame:
    """method: mean, median, least and largest score, total time; rows with an error are left out."""
    return results.filter("error IS NULL").groupBy("method").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.min("score").alias("least"), F.max("score").alias("most"), F.sum("seconds").alias("total"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """As runner_summary, by method, mode of refinement and size of ensemble, with the means of the other scores."""
    means = [F.avg(c).alias(f"{c}_mean") for c in ("recall", "precision", "f1", "tc") if c in results.columns]
    return results.filter("error IS NULL").groupBy("method", "refine", "ensemble").agg(
        F.count("*").alias("n_cases"), F.avg("score").alias("sp_mean"), F.median("score").alias("sp_median"), F.min("score").alias("sp_min"), F.max("score").alias("sp_max"), F.sum("seconds").alias("total_time"), *means,
    )


def spread_ci(results: DataFrame, resamples: int = 10_000, least: int = 5) -> DataFrame:
    """spread, and the bootstrap interval of the mean for methods with at least so many results (else null)."""
    out, ci = spread(results), bootstrap_ci(results, resamples).select("method", "low", "high")
    n = results.groupBy("method").agg(F.count("*").alias("n"))
    both = out.join(n, "method").join(ci, "method")
    return both.select("method", "n", "mean", "deviation", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("low", "high")])


def spread(results: DataFrame) -> DataFrame:
    """method: mean and population deviation of the score."""
    return results.groupBy("method").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))


def paired(results: DataFrame) -> DataFrame:
    """a, b, family, x, y: scores of every two methods on the families that both have; a < b."""
    x = results.select("family", F.col("method").alias("a"), F.col("score").alias("x"))
    y = results.select("family", F.col("method").alias("b"), F.col("score").alias("y"))
    return x.join(y, "family").filter("a < b").select("a", "b", "family", "x", "y")


def cliffs_delta(pairs: DataFrame, least: int = 5) -> DataFrame:
    """a, b, n, delta: (wins - losses) / n over paired families, for pairs of methods with enough of them."""
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), ((F.count_if(F.col("x") > F.col("y")) - F.count_if(F.col("x") < F.col("y"))) / F.count("*")).alias("delta"))
    return out.filter(F.col("n") >= least)


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """a, b, w, p: signed-rank statistic (zeros dropped, mean ranks for ties) and its normal approximation.

    Mean ranks come from counts of equal differences, so equal ones never meet in one row-by-row sort.
    """
    d = pairs.select("a", "b", (F.col("x") - F.col("y")).alias("d")).filter("d <> 0")
    sizes = d.groupBy("a", "b", F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    w = Window.partitionBy("a", "b").orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("rank", F.sum("t").over(w) - (F.col("t") - 1) / 2)
    out = ranked.groupBy("a", "b").agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("up"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("down"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    stat = F.least("up", "down")
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    z = (stat - F.col("n") * (F.col("n") + 1) / 4) / F.nullif(sd, F.lit(0.0))
    # two-sided tail by a rational approximation (absolute error under 1.5e-7)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return out.select("a", "b", "n", stat.alias("w"), F.coalesce(tail, F.lit(1.0)).alias("p"))


def holm(tests: DataFrame) -> DataFrame:
    """tests (grp, id, p) with adjusted: running maximum of p times the number of tests not yet passed, at most 1."""
    n = Window.partitionBy("grp")
    order = Window.partitionBy("grp").orderBy("p", "id")
    step = tests.withColumn("k", F.row_number().over(order)).withColumn("m", F.count("*").over(n))
    return step.withColumn("adjusted", F.least(F.lit(1.0), F.max(F.col("p") * (F.col("m") - F.col("k") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("k", "m")


def bootstrap_ci(results: DataFrame, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """method, mean, low, high: percentile interval of the mean; one group of scores at a time in NumPy."""
    import numpy as np
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(group["score"].to_numpy(float))
        rng, means = np.random.default_rng(seed), []
        for i in range(0, resamples, 500):
            means.append(v[rng.integers(0, len(v), (min(500, resamples - i), len(v)))].mean(axis=1))
        low, high = np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([(group["method"].iloc[0], v.mean(), low, high)], columns=["method", "mean", "low", "high"])

    return results.select("method", "score").groupBy("method").applyInPandas(run, "method string, mean double, low double, high double")


def simulation_grid(spark, axes: dict[str, list]) -> DataFrame:
    """A row for each combination of the axes' values, with sim_id naming them."""
    out = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(k) for k, values in axes.items()])
    for k in axes:
        out = out.withColumn(k, F.explode(k))
    return out.withColumn("sim_id", F.concat_ws("_", *[F.concat(F.lit(k), F.col(k).cast("string")) for k in axes]))


def by_parameter(results: DataFrame, name: str) -> DataFrame:
    """value, n, score: means by a parameter parsed from sim_id."""
    value = F.regexp_extract("sim_id", rf"(?:^|_){name}([0-9.]+)", 1)
    return results.filter(value != "").groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.avg("score").alias("score"))


def results_frame(results: DataFrame) -> DataFrame:
    """Results without errors, scores filled, with a label of their method and dataset."""
    kept = results.filter("error IS NULL").fillna({"score": 0.0, "seconds": 0.0})
    return kept.withColumn("label", F.concat_ws(" / ", "method", "dataset")).drop("error")


def json_means(rows: DataFrame, group: str, json: str, path: str) -> DataFrame:
    """group, n, mean of a number at a path of a JSON text; rows without it are left out."""
    value = F.get_json_object(json, path).try_cast("double")
    return rows.select(F.col(group).alias("grp"), value.alias("v")).filter("v IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
