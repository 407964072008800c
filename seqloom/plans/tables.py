"""Sequence families and test alignments out of the driver's tables, for the registered queries.

Each has its SQL beside it; the ASCII filter runs before upper() so that every engine folds case alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 60
ALPHABETS = {"dna": "ACGT", "protein": "ACDEFGHIKLMNPQRSTVWY"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, kind: str = "dna") -> DataFrame:
    """family, rank, name, seq: the letters of each whole document, a family for each source."""
    letters = ALPHABETS[kind]
    seq = F.upper(F.regexp_replace("text", f"[^{letters}{letters.lower()}]", ""))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("family"), F.col("doc_id").alias("rank"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq"))


def sequences_sql(kind: str = "dna") -> str:
    letters = ALPHABETS[kind]
    seq = f"upper(regexp_replace(text, '[^{letters}{letters.lower()}]', '', 'g'))"
    return f"(SELECT source AS family, doc_id AS rank, 'd' || doc_id AS name, {seq} AS seq FROM documents)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, rank, name, seq: each whole document's letters in rows of SEGMENT, a family for each document that has letters."""
    docs = sequences(spark, sf_dir).filter(F.length("seq") > 0)
    rank = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / SEGMENT).cast("int")))
    cut = docs.select(F.col("name").alias("family"), rank.alias("rank"), F.col("seq").alias("whole"))
    return cut.select("family", "rank", F.concat(F.lit("s"), F.col("rank").cast("string")).alias("name"), F.col("whole").substr(F.col("rank") * SEGMENT + 1, F.lit(SEGMENT)).alias("seq"))


SEGMENTS_SQL = f"""(SELECT family, r::INT AS rank, 's' || r AS name, substr(seq, (r * {SEGMENT} + 1)::INT, {SEGMENT}) AS seq
  FROM (SELECT name AS family, seq, unnest(range(0, (length(seq) - 1) // {SEGMENT} + 1)) AS r FROM {sequences_sql()} WHERE length(seq) > 0))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, run_id, rank, name, aligned: three alignments of the segments, four columns wider than they."""
    s = segments(spark, sf_dir).withColumn("s", F.rpad("seq", SEGMENT, "-")).withColumn("k", F.expr("cast(rank % 5 AS INT)"))
    pad, rest, half = F.expr("repeat('-', k)"), F.expr("repeat('-', 4 - k)"), SEGMENT // 2
    made = F.array(F.concat(pad, "s", rest), F.concat(F.substring("s", 1, half), pad, F.substring("s", half + 1, half), rest), F.concat("s", F.lit("----")))
    return s.select("family", F.posexplode(made).alias("run_id", "aligned"), "rank", "name").select("family", "run_id", "rank", "name", "aligned")


RUNS_SQL = f"""(SELECT family, run_id, rank, name, CASE run_id WHEN 0 THEN repeat('-', k) || s || repeat('-', 4 - k)
  WHEN 1 THEN substr(s, 1, {SEGMENT // 2}) || repeat('-', k) || substr(s, {SEGMENT // 2 + 1}) || repeat('-', 4 - k) ELSE s || '----' END AS aligned
  FROM (SELECT *, rpad(seq, {SEGMENT}, '-') AS s, (rank % 5)::INT AS k FROM {SEGMENTS_SQL}) CROSS JOIN (SELECT unnest([0, 1, 2]) AS run_id))"""

#: family, run_id, rank, col (from 0), ch, pos (index of the residue in its row, null for a gap)
LONG_SQL = f"""(SELECT family, run_id, rank, col, ch, CASE WHEN ch <> '-' THEN sum((ch <> '-')::INT) OVER (PARTITION BY family, run_id, rank ORDER BY col) - 1 END AS pos
  FROM (SELECT family, run_id, rank, i - 1 AS col, substr(aligned, i, 1) AS ch FROM (SELECT *, unnest(range(1, length(aligned) + 1)) AS i FROM {RUNS_SQL})))"""
