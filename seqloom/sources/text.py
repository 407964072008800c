"""Readers: FASTA, Clustal, MSF, Stockholm, hit tables, column masks.  Files are lines; a file's lines keep their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """path, content: whole text files; deep: of the folders below as well."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=deep).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def lines(whole: DataFrame) -> DataFrame:
    """path, no, line: each cut at its first control character."""
    out = whole.select("path", F.posexplode(F.split("content", "\n")).alias("no", "line"))
    return out.withColumn("line", F.regexp_replace("line", r"[\x00-\x1f\x7f].*$", ""))


def sniff(text: DataFrame, first: int = 100) -> DataFrame:
    """path, format by marks in the first lines; of several the last of fasta, msf, clustal."""
    head = text.filter(F.col("no") < first)
    has = lambda *words: F.max(F.greatest(*[F.contains("line", F.lit(w)) for w in words], F.lit(False)))
    marks = head.groupBy("path").agg(
        has("CLUSTAL W", "CLUSTAL O", "multiple sequence alignment").alias("clu"),
        has("MSF:", "!!AA_MULTIPLE_ALIGNMENT", "!!NA_MULTIPLE_ALIGNMENT").alias("msf"),
        F.max(F.startswith("line", F.lit(">"))).alias("fa"),
    )
    return marks.select("path", F.when(F.col("clu"), "clustal").when(F.col("msf"), "msf").when(F.col("fa"), "fasta").alias("format"))


def fasta(whole: DataFrame, strict: bool = False) -> DataFrame:
    """path, rank, name, aligned, seq: records of FASTA text; punctuation is a gap, other signs are left out.

    A record is a piece of its file's text, so no lines meet in a window.  Letters before the first header are left out, or,
    if strict, an error.
    """
    body = F.regexp_replace(F.concat(F.lit("\n"), "content"), "\r", "")
    records = F.split(body, "\n>")
    early = F.raise_error(F.concat(F.lit("text before the first header in "), "path")).cast("boolean")
    out = whole.select("path", F.posexplode(records).alias("k", "record")).filter(F.when((F.col("k") == 0) & F.lit(strict) & F.col("record").rlike("[A-Za-z]"), early).otherwise(F.col("k") > 0))
    name = F.split("record", "\n", 2)[0]
    rest = F.coalesce(F.get(F.split("record", "\n", 2), F.lit(1)), F.lit(""))
    aligned = F.regexp_replace(F.regexp_replace(rest, r"\p{Punct}", "-"), "[^A-Za-z-]", "")
    return out.select("path", (F.col("k") - 1).cast("int").alias("rank"), name.alias("name"), aligned.alias("aligned"), F.regexp_replace(aligned, "-", "").alias("seq"))


def short_name(name):
    """Up to the first blank."""
    return F.regexp_extract(name, r"^[^ \t]*", 0)


def _blocks(rows: DataFrame) -> DataFrame:
    """path, no, line of block text -> path, rank, name, aligned: rows are matched by their order within a block."""
    w = Window.partitionBy("path").orderBy("no")
    blank = F.trim("line") == ""
    marked = rows.withColumn("block", F.sum(F.when(blank, 1).otherwise(0)).over(w)).filter(~blank & ~F.startswith("line", F.lit(" ")))
    placed = marked.withColumn("rank", F.row_number().over(Window.partitionBy("path", "block").orderBy("no")) - 1)
    name = F.regexp_extract("line", r"^(\S+)", 1)
    part = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^\S+\s+", ""), r"\s+[0-9]+\s*$", ""), r"\s", "")
    got = placed.select("path", "rank", "no", name.alias("name"), F.regexp_replace(part, r"[.~]", "-").alias("part"))
    cells = F.array_sort(F.collect_list(F.struct("no", "part")))
    return got.groupBy("path", "rank").agg(F.min_by("name", "no").alias("name"), F.array_join(F.transform(cells, lambda c: c["part"]), "").alias("aligned"))


def clustal(text: DataFrame) -> DataFrame:
    return _blocks(text.filter("no > 0"))


def msf(text: DataFrame) -> DataFrame:
    """Rows after the line '//'."""
    w = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    after = text.withColumn("past", F.coalesce(F.max(F.startswith("line", F.lit("//"))).over(w), F.lit(False)))
    return _blocks(after.filter("past").select("path", "no", "line"))


def stockholm(text: DataFrame) -> DataFrame:
    rows = text.filter(~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit("//")) & (F.trim("line") != ""))
    got = rows.select("path", "no", F.regexp_extract("line", r"^(\S+)\s+(\S+)", 1).alias("name"), F.regexp_extract("line", r"^(\S+)\s+(\S+)", 2).alias("part"))
    cells = F.array_sort(F.collect_list(F.struct("no", "part")))
    return got.groupBy("path", "name").agg(F.min("no").alias("first"), F.array_join(F.transform(cells, lambda c: c["part"]), "").alias("aligned")).withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("first")) - 1).drop("first")


def hit_table(text: DataFrame) -> DataFrame:
    """path, name, e_value, score of rows with six fields or more; comments and broken numbers are left out."""
    f = F.split(F.trim("line"), r"\s+")
    rows = text.filter(~F.startswith("line", F.lit("#"))).withColumn("f", f).filter(F.size("f") >= 6)
    got = rows.select("path", F.col("f")[0].alias("name"), F.expr("try_cast(f[4] AS double)").alias("e_value"), F.expr("try_cast(f[5] AS double)").alias("score"))
    return got.filter("e_value IS NOT NULL AND score IS NOT NULL")


def column_mask(whole: DataFrame) -> DataFrame:
    """path, col, mask from the numbers of an XML element colsco-data; 1 marks a core column."""
    data = F.regexp_extract("content", r"(?s)<colsco-data>\s*(.*?)\s*</colsco-data>", 1)
    return whole.select("path", F.posexplode(F.split(data, r"\s+")).alias("col", "v")).filter("v <> ''").select("path", "col", (F.col("v") == "1").cast("int").alias("mask"))


def upper(rows: DataFrame) -> DataFrame:
    """Rows of text in capitals, with '-' for '.'."""
    return rows.withColumn("aligned", F.translate(F.upper("aligned"), ".", "-"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """path, format, rank, name, aligned of text files, each by the format its first lines show; a file of no known format,
    or of fewer than two sequences, is an error."""
    return parse_any(files(spark, path))


def parse_any(whole: DataFrame) -> DataFrame:
    """read_any of files (path, content)."""
    kinds = sniff(lines(whole))
    told = F.when(F.col("format").isNull(), F.raise_error(F.concat(F.lit("no known format in "), "path")).cast("string")).otherwise(F.col("format"))
    known = whole.join(kinds, "path").select("path", "content", told.alias("format"))
    made = None
    for kind, parse in (("fasta", lambda x: fasta(x, strict=True)), ("clustal", lambda x: clustal(lines(x))), ("msf", lambda x: msf(lines(x)))):
        part = parse(known.filter(F.col("format") == kind).select("path", "content")).select("path", F.lit(kind).alias("format"), F.col("rank").cast("long").alias("rank"), "name", "aligned")
        made = part if made is None else made.union(part)
    few = F.raise_error(F.concat(F.lit("fewer than two sequences in "), "path")).cast("long")
    return made.withColumn("rank", F.when(F.count("*").over(Window.partitionBy("path")) < 2, few).otherwise(F.col("rank")))


def union_of_one_kind(*inputs: DataFrame) -> DataFrame:
    """union_inputs of inputs (family, rank, name, seq); inputs of other alphabets than the first are an error.

    input counts from 0; ranks go on from input to input.
    """
    from seqloom.operators.columns import detect_alphabet, letter_histogram

    both = union_inputs(*[x.withColumn("input", F.lit(i)) for i, x in enumerate(inputs)])
    kinds = detect_alphabet(letter_histogram(both.select(F.col("input").alias("family"), "seq")))
    told = F.raise_error(F.lit("inputs of several alphabets")).cast("boolean")
    one = kinds.agg((F.countDistinct("kind") > 1).alias("mixed")).select(F.when(F.col("mixed"), told).otherwise(True).alias("one"))
    order = Window.partitionBy("family").orderBy("input", "rank")
    placed = both.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    return placed.join(F.broadcast(one), F.col("one")).drop("one")  # a single row


def union_inputs(*inputs: DataFrame) -> DataFrame:
    out = inputs[0]
    for x in inputs[1:]:
        out = out.unionByName(x)
    return out


def tasks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Merge tasks a, b, c, p, n."""
    return spark.read.schema("a int, b int, c int, p int, n int").csv(path)


def results_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")
