"""Cleaning, validation and ordering of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.columns import gcg_checksum


def drop_empty(seqs: DataFrame) -> DataFrame:
    return seqs.filter(F.length("seq") > 0)


def invalid(seqs: DataFrame) -> DataFrame:
    """family, rank, problem: rows that no alignment takes."""
    problem = F.when(F.col("seq").isNull() | (F.trim("seq") == ""), "blank").when(F.col("seq").rlike("[0-9]"), "digit").when(F.col("seq").rlike(r"[\x00-\x1f]"), "control")
    return seqs.select("family", "rank", problem.alias("problem")).filter("problem IS NOT NULL")


def essential(seqs: DataFrame) -> DataFrame:
    """Rows with residues, with the ranks they had; a family with fewer than two of them is an error."""
    n = F.count("*").over(Window.partitionBy("family"))
    few = F.raise_error(F.concat(F.lit("family "), "family", F.lit(" has fewer than two sequences"))).cast("long")
    return drop_empty(seqs).withColumn("rank", F.when(n < 2, few).otherwise(F.col("rank")))


def checked(seqs: DataFrame) -> DataFrame:
    """The rows themselves; a blank one, or one with digits or control characters, is an error when it is read, and so is a
    family of one."""
    bad = F.when(F.col("seq").isNull() | (F.trim("seq") == ""), "is empty").when(F.col("seq").rlike("[0-9]"), "has digits").when(F.regexp_replace("seq", r"[\t\n\r]", "").rlike(r"[\x00-\x1f]"), "has control characters")
    told = F.concat(F.lit("sequence "), F.col("rank").cast("string"), F.lit(" of family "), F.col("family").cast("string"), F.lit(" "), bad)
    return essential(seqs.withColumn("seq", F.when(bad.isNotNull(), F.raise_error(told).cast("string")).otherwise(F.col("seq"))))


def mostly_short(seqs: DataFrame, least: int = 3) -> DataFrame:
    """family: those of whose sequences more than half are shorter than `least`, for a warning."""
    return seqs.groupBy("family").agg(F.avg((F.length(F.trim("seq")) < least).cast("int")).alias("share")).filter("share > 0.5").select("family")


def duplicates(seqs: DataFrame) -> DataFrame:
    """family, name, n, sequences: names that occur again, with the number of distinct checksums behind them."""
    return seqs.groupBy("family", "name").agg(F.count("*").alias("n"), F.countDistinct(gcg_checksum("seq")).alias("sequences")).filter("n > 1")


def unique_names(seqs: DataFrame) -> DataFrame:
    """The rows themselves; a name that occurs again in its family is an error."""
    n = F.count("*").over(Window.partitionBy("family", "name"))
    told = F.concat(F.lit("name "), "name", F.lit(" occurs again in family "), "family")
    return seqs.withColumn("name", F.when(n > 1, F.raise_error(told).cast("string")).otherwise(F.col("name")))


def duplicate_names(seqs: DataFrame) -> DataFrame:
    """Rows whose name occurs again in their family get a running suffix, in order of name and rank."""
    again = F.count("*").over(Window.partitionBy("family", "name")) > 1
    flagged = seqs.withColumn("again", again)
    turn = F.row_number().over(Window.partitionBy("family", "again").orderBy("name", "rank"))
    return flagged.withColumn("name", F.when(F.col("again"), F.concat_ws("_", "name", turn.cast("string"))).otherwise(F.col("name"))).drop("again")


def rename(seqs: DataFrame) -> DataFrame:
    """SEQ1.. in the order of ranks."""
    return seqs.withColumn("name", F.concat(F.lit("SEQ"), F.row_number().over(Window.partitionBy("family").orderBy("rank")).cast("string")))


def canonical_order(seqs: DataFrame) -> DataFrame:
    """place: by length, longest first, then name, then rank."""
    return seqs.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.length("seq").desc(), "name", "rank")) - 1)


def anchors(seqs: DataFrame, most: int = 32) -> DataFrame:
    """Every n / K-th sequence in canonical order, K = min(most, n)."""
    placed = canonical_order(seqs).withColumn("n", F.count("*").over(Window.partitionBy("family")))
    k = F.least(F.lit(most), F.col("n"))
    stride = F.floor(F.col("n") / k)
    return placed.filter((F.col("place") % stride == 0) & (F.col("place") < k * stride)).drop("n")


def kmer_diagonals(seqs: DataFrame, k: int = 6) -> DataFrame:
    """family, i, j, score: words of k letters that two sequences share on their best diagonal.

    Words are joined by family and word, so a word's places meet, not sequences.
    """
    places = F.transform(F.sequence(F.lit(0), F.length("seq") - k), lambda p: F.struct(p.alias("p"), F.substring("seq", p + 1, F.lit(k)).alias("w")))
    words = seqs.filter(F.length("seq") >= k).select("family", "rank", F.explode(places).alias("x")).select("family", "rank", "x.p", "x.w")
    a = words.select("family", "w", F.col("rank").alias("i"), F.col("p").alias("a"))
    b = words.select("family", "w", F.col("rank").alias("j"), F.col("p").alias("b"))
    on = a.join(b, ["family", "w"]).filter("i < j").groupBy("family", "i", "j", (F.col("a") - F.col("b")).alias("diagonal")).agg(F.count("*").alias("n"))
    return on.groupBy("family", "i", "j").agg(F.max("n").alias("score"))


def length_ratio(seqs: DataFrame) -> DataFrame:
    """family, ratio, matrix: longest over shortest; under 1.5 the matrix of near families, else of far ones.

    Nucleotides have no such choice: with alphabet (family, kind) given, families that are no proteins are near.
    """
    out = seqs.groupBy("family").agg((F.max(F.length("seq")) / F.min(F.length("seq"))).alias("ratio"))
    return out.withColumn("matrix", F.when(F.col("ratio") < 1.5, "near").otherwise("far"))


def sorted_by(seqs: DataFrame, by: str) -> DataFrame:
    """place by 'length' (longest first), 'name' or 'checksum' (highest first); ranks settle ties."""
    key = {"length": F.length("seq").desc(), "name": F.col("name").asc(), "checksum": gcg_checksum("seq").desc()}[by]
    return seqs.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(key, "rank")) - 1)


def shuffle(seqs: DataFrame, seed: int) -> DataFrame:
    """place in an order drawn by the seed, the same on every cluster."""
    return seqs.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64(F.lit(seed), "rank"), "rank")) - 1)
