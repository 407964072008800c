"""Readers of record formats: GenBank, EMBL and Swiss-Prot entries, PHYLIP, per-site classes, outside confidence scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(whole: DataFrame, kind: str) -> DataFrame:
    """path, rank, name, seq from entries that end with a line '//'; kind: genbank, embl or swiss."""
    name, start = {"genbank": (r"(?m)^LOCUS\s+(\S+)", "(?m)^ORIGIN.*$"), "embl": (r"(?m)^ID\s+([^\s;]+)", "(?m)^SQ .*$"), "swiss": (r"(?m)^ID\s+(\S+)", "(?m)^SQ .*$")}[kind]
    cut = whole.select("path", F.posexplode(F.split("content", r"(?m)^//\s*$")).alias("k", "entry")).filter(F.col("entry").rlike(start))
    tail = F.get(F.split("entry", start, 2), F.lit(1))
    return cut.select("path", F.col("k").cast("int").alias("rank"), F.regexp_extract("entry", name, 1).alias("name"), F.upper(F.regexp_replace(tail, "[^A-Za-z]", "")).alias("seq"))


def phylip(whole: DataFrame) -> DataFrame:
    """path, rank, name, aligned of sequential PHYLIP: a count line, then a name and its row on each line."""
    rows = whole.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("no", "line")).filter((F.col("no") > 0) & (F.trim("line") != ""))
    m = r"^\s*(\S+)\s+(.*)$"
    return rows.select("path", (F.col("no") - 1).cast("int").alias("rank"), F.regexp_extract("line", m, 1).alias("name"), F.regexp_replace(F.regexp_extract("line", m, 2), r"\s", "").alias("aligned"))


def _field(k: int, kind: str):
    """The k-th blank-separated field of a line, null where it is missing or no such value."""
    return F.expr(f"try_cast(get(split(trim(line), '\\\\s+'), {k}) AS {kind})")


def site_classes(text: DataFrame, positive: int) -> DataFrame:
    """path, site, selected from rows 'site class': whether the class is the positive one or above."""
    got = text.select("path", _field(0, "int").alias("site"), _field(1, "int").alias("class"))
    return got.filter("site IS NOT NULL AND class IS NOT NULL").select("path", "site", (F.col("class") >= positive).cast("int").alias("selected"))


def column_scores(text: DataFrame) -> DataFrame:
    """path, col, confidence from rows 'column score' (columns from 1); others are left out."""
    got = text.select("path", _field(0, "int").alias("c"), _field(1, "double").alias("confidence"))
    return got.filter("c IS NOT NULL AND confidence IS NOT NULL").select("path", (F.col("c") - 1).alias("col"), "confidence")


def residue_scores(text: DataFrame) -> DataFrame:
    """path, col, rank, confidence from rows 'column row score' (both from 1)."""
    got = text.select("path", _field(0, "int").alias("c"), _field(1, "int").alias("r"), _field(2, "double").alias("confidence"))
    return got.filter("c IS NOT NULL AND r IS NOT NULL AND confidence IS NOT NULL").select("path", (F.col("c") - 1).alias("col"), (F.col("r") - 1).alias("rank"), "confidence")
