"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its content.  A ledger, a Parquet table, holds for each blob
which rule versions have read it and what they found.  An update reads only blobs with an unseen pair of blob and rule
version, each distinct content once, and appends what it finds; findings are joined back to every path that has held
the blob.  All queries go through a ledger; theirs begins empty.

The rules are the three base kinds and, after them, token shapes that their issuers publish.

Defined results: a null text is the empty blob; repeated paths and repeated rows each get their row; an empty table
gives an empty result; extra columns are ignored, whatever their names; offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import fresh, new_path, written

#: Stands around a match while a text is cut; a text's own copies become MASK, one code point as well, and no rule
#: tells the two apart.
MARK, MASK = "\ue000", "\ue001"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """pattern: matched leftmost, non-overlapping; group/least: that group of a match needs so many characters.

    holds: what every match holds, or nothing; texts without it are not given to the pattern.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    holds: str = ""

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: A maximal run has the least length or holds no match at all, so the bound of the last two can stand in the pattern.
RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", holds="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
    # fixed values: token shapes as published
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", holds="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", holds="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", holds="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", holds="eyJ"),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,ord:int,end:int>>"


def rule_spans(content: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind_order, end) of one rule's matches in a text."""
    pieces = F.split(F.regexp_replace(F.translate(content, MARK, MASK), rule.pattern, f"{MARK}$0{MARK}"), MARK, -1)
    none = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), none.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.length(piece)
        span = F.struct(acc["pos"].alias("start"), F.lit(order).alias("ord"), end.alias("end"))
        keep = acc["hit"]
        if rule.least:
            keep = keep & (F.length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least)
        return F.struct(end.alias("pos"), (~acc["hit"]).alias("hit"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # most texts hold no match: they are only looked through, not rebuilt
    found = F.contains(content, F.lit(rule.holds)) & content.rlike(rule.pattern) if rule.holds else content.rlike(rule.pattern)
    return F.when(found, F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(none)


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob, content: a row for each version of each path."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("content"))


class Ledger:
    """blob, tags (rule versions that have read it), spans (found; ord is the rule's place), n_spans: a row an update.

    Rules keep their places from version to version: new kinds go to the end.
    """

    SCHEMA = f"blob string, tags array<string>, spans {SPANS}, n_spans int"

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> None:
        """path: where the ledger is or is to be; without one a new ledger in the shared folder."""
        self.spark, self.rules, self.path = spark, rules, path or new_path(spark, "ledger")
        # an empty append makes the folder, so that there is something to read
        spark.createDataFrame([], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def unseen(self, paths: DataFrame) -> DataFrame:
        """blob, todo: the tags of the rules that have not read a blob of paths; no content is read for it."""
        tags = F.array(*[F.lit(r.tag) for r in self.rules])
        seen = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("seen"))
        todo = F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>")))
        return paths.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)

    def update(self, paths: DataFrame) -> None:
        """Reads the blobs of paths (path, blob, content) with unseen pairs and appends a row for each of them.

        What is unseen is written first: its size is then known, and where it is small no content is shuffled.
        """
        unseen = written(self.unseen(paths), "unseen")
        # one copy of each content; the partial aggregate drops copies before the shuffle
        blobs = paths.select("blob", "content").join(unseen, "blob").groupBy("blob").agg(F.first("content").alias("content"), F.first("todo").alias("todo"))
        found = [F.when(F.array_contains("todo", r.tag), rule_spans(F.col("content"), r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(self.rules)]
        done = blobs.select("blob", F.col("todo").alias("tags"), F.array_sort(F.concat(*found)).alias("spans"))
        done.withColumn("n_spans", F.size("spans")).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """blob, spans by start, then rule: of the present rules' versions, for blobs with any."""
        held = self.rows().filter("n_spans > 0")
        now = F.array(*[F.lit(r.tag) for r in self.rules])
        # a row's spans count where the rule at that place was read for it in its present version
        own = F.filter("spans", lambda s: F.array_contains(F.col("tags"), F.get(now, s["ord"])))
        return held.select("blob", own.alias("spans")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")).filter(F.size("spans") > 0)

    def by_path(self, paths: DataFrame) -> DataFrame:
        """path, blob, spans: findings joined back to all paths."""
        spans = self.findings()
        return paths.select("path", "blob").join(spans, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """The query's rows: counts of the base kinds, the hash of their joined spans, all spans."""
    paths = versions(docs)
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(paths)
    found = ledger.by_path(paths)
    of = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    base = joined(F.filter("spans", lambda s: s["ord"] < len(BASE)))
    out = found.select(F.col("path").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), base.alias("base"), joined(F.col("spans")).alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, label: str = "[SECRET]", ledger: Ledger | None = None) -> DataFrame:
    """documents with every found span replaced by label; the other columns as they were, n_chars counted anew."""
    own, held = fresh(docs.columns, "blob", "spans")
    base = docs.withColumn(own, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs.select(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("content")))
    spans = ledger.findings().toDF(own, held)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        # overlapping spans of two rules give one label
        before = F.when(s["start"] > acc["pos"], text.substr(acc["pos"] + 1, s["start"] - acc["pos"])).otherwise("")
        mark = F.when(s["start"] >= acc["pos"], F.lit(label)).otherwise("")
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], before, mark).alias("out"))

    clean = F.aggregate(held, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["pos"] + 1, F.length(text))))
    out = base.join(spans, own, "left").withColumn("text", F.when(F.col(held).isNotNull(), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(held).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _duck_rule(i: int, r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    parts = f"string_split(regexp_replace(replace(coalesce(text, ''), chr(57344), chr(57345)), '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344))"
    keep = f"AND length(regexp_extract(parts[2 * k], '{pattern}', {r.group})) >= {r.least}" if r.least else ""
    return f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind,
      coalesce(list_sum(list_transform(parts[1:2 * k - 1], lambda x: length(x))), 0)::BIGINT AS s, length(parts[2 * k]) AS n
      FROM (SELECT doc_id, parts, unnest(range(1, (len(parts) + 1) // 2)) AS k FROM (SELECT doc_id, {parts} AS parts FROM documents)) WHERE true {keep}"""


SQL = f"""
WITH found AS ({' UNION ALL '.join(_duck_rule(i, r) for i, r in enumerate(RULES))}),
agg AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord) AS spans,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS base FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN agg USING (doc_id)
"""
