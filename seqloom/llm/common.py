"""What the training-data operators share: shared folders, written tables, small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a folder of our own serves, if driver and executors are one process, as in tests; on a cluster that
    is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that no run has used."""
    return f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd", files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation.

    files: how many at most, for tables of small rows; see files_for.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if files is None else df.coalesce(files)).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that are needed until a run's results are written, and then removed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, without a copy: Python objects of a part at a time are made of them."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def files_for(rows: int, each: int = 50_000, least: int = 24) -> int:
    """Files for a table of so many small rows: few small ones, yet as many as keep a large cluster busy."""
    return max(least, -(-rows // each))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like those given that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """checkpoint() to the shared folder, for iterative tables; of known size, in files of up to 250,000 rows."""
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(8, -(-rows // 250_000)))).checkpoint()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: UTF-8 bytes of texts in a range of ids, one task's share; twice as many from MOST_RANGES ranges on, and so forth.
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 16


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(whole_text())).alias("n")).first()["n"] or 0


def ranges_for(size: int) -> int:
    """Ranges for so many bytes."""
    each = RANGE_BYTES
    while size > each * MOST_RANGES:
        each *= 2
    return max(1, -(-size // each))


#: Stand for a null id in an order, before or after all others.
FIRST, LAST = -(2**63), 2**63 - 1


def id_bounds(docs: DataFrame, count: int, id_col: str = "doc_id") -> list[int]:
    """Bounds that cut the ids of docs into `count` ranges of near-equal size, an id of very many rows more than once;
    reads the id column alone."""
    if count < 2:
        return []
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("id"))
    got = ids.agg(F.percentile_approx("id", [i / count for i in range(1, count)], max(10_000, 2 * count)).alias("q")).first()["q"]
    return sorted(got or [])
