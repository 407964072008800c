"""The corpus pipeline: documents through five training-data operators, each stage over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.

Null texts count as empty, repeated rows and empty tables go through, extra columns stay; see the operators for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontaminate, packing, secret_ledger, simhash, toxicity
from seqloom.llm.common import table, written

#: Near duplicates: texts whose SimHash fingerprints op10 puts in one component, or that agree in a band of so many least
#: hashes, are candidates; a Jaccard similarity of 0.8 or more of their five-word shingles links them, and one document of
#: each component of links stays.
SHINGLE, ROWS, SIMILARITY = 5, 5, 0.8
#: Pieces of text whose ids a worker remembers while it packs; less than alone, as other stages hold memory too.
PIECES = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, SHINGLE, ROWS, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, kept=PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: A trained classifier, a tokenizer and fingerprints are no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
