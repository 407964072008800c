"""Letter histograms and pair support over streams of rows: both are sums that later rows only add to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_fasta(spark, path: str) -> DataFrame:
    """A stream of whole FASTA files: path, content."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def histogram(rows: DataFrame) -> DataFrame:
    """family, ch, n in update or complete mode."""
    return rows.select("family", F.explode(F.split("seq", "")).alias("ch")).filter("ch <> ''").groupBy("family", "ch").agg(F.count("*").alias("n"))


def align_each_batch(rows: DataFrame, target: str, mode: str = "fast", checkpoint: str | None = None):
    """Aligns the families of each micro-batch (a file is a family, so it comes whole) and appends them to Parquet."""
    from seqloom.operators.align import align

    def run(batch: DataFrame, _: int) -> None:
        align(batch, mode).write.mode("append").parquet(target)

    writer = rows.writeStream.foreachBatch(run).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
