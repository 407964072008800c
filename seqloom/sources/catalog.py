"""Catalogues of benchmark cases from the paths of a folder: unaligned input paired with its reference alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """path of every file under a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def _parts(files: DataFrame) -> DataFrame:
    """path, folder, stem, suffix."""
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("suffix"))


def beside(files: DataFrame, prefix: str, unaligned: str = "tfa", reference: str = "msf", category: str = "RV", skip: str = "BBS") -> DataFrame:
    """family, dataset, unaligned, reference: files of one stem beside each other, without stems that begin with `skip`.

    dataset: the prefix and the first folder whose name begins with `category`.
    """
    p = _parts(files).filter(~F.startswith("stem", F.lit(skip)))
    a = p.filter(F.col("suffix") == unaligned).select("folder", "stem", F.col("path").alias("unaligned"))
    b = p.filter(F.col("suffix") == reference).select("folder", "stem", F.col("path").alias("reference"))
    kind = F.regexp_extract("folder", rf"/({category}[^/]*)(?:/|$)", 1)
    return a.join(b, ["folder", "stem"]).select(F.col("stem").alias("family"), F.concat(F.lit(prefix), F.when(kind != "", F.concat(F.lit("_"), kind)).otherwise("")).alias("dataset"), "unaligned", "reference")


def in_folders(files: DataFrame, prefix: str, unaligned: str, reference: str, suffixes: tuple[str, ...] = ("fa", "fasta"), by_folder: bool = False) -> DataFrame:
    """As beside, for files of one stem in two folders beside each other; the reference's own suffix is preferred.

    by_folder: dataset names the folder that holds the two.
    """
    p = _parts(files).filter(F.col("suffix").isin(*suffixes))
    over = lambda name: F.regexp_extract("folder", rf"^(.*)/{name}$", 1)
    a = p.withColumn("over", over(unaligned)).filter("over <> ''").select("over", "stem", F.col("suffix").alias("s"), F.col("path").alias("unaligned"))
    b = p.withColumn("over", over(reference)).filter("over <> ''").select("over", "stem", "suffix", F.col("path").alias("reference"))
    met = b.join(a, ["over", "stem"]).groupBy("over", "stem", "reference").agg(F.min_by("unaligned", F.struct((F.col("s") != F.col("suffix")).alias("other"), "s")).alias("unaligned"))
    name = F.concat(F.lit(f"{prefix}_"), F.regexp_extract("over", r"([^/]*)$", 1)) if by_folder else F.lit(prefix)
    return met.select(F.col("stem").alias("family"), name.alias("dataset"), "unaligned", "reference")


def first_cases(cases: DataFrame, most: int = 0) -> DataFrame:
    """At most so many cases in the order of their references; 0: all."""
    return cases.orderBy("reference").limit(most) if most else cases


def latest(files: DataFrame, stem: str) -> DataFrame:
    """path: of the files whose name is the stem and a time stamp, the one with the last."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.filter(F.startswith(name, F.lit(stem))).agg(F.max_by("path", name).alias("path")).filter("path IS NOT NULL")
