"""Writers: aligned rows as FASTA, Clustal, MSF, Stockholm or PHYLIP text; formatting is column expressions."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.columns import gcg_checksum

FORMATS = {"fa": "fasta", "fasta": "fasta", "clu": "clustal", "aln": "clustal", "clustal": "clustal", "msf": "msf", "sto": "stockholm", "stockholm": "stockholm", "phy": "phylip", "phylip-interleaved": "phylip-interleaved", "phylip": "phylip"}


def wrapped(text: Column, width: int) -> Column:
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(wide: DataFrame, width: int = 60) -> DataFrame:
    """family, rank, record."""
    return wide.select("family", "rank", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("aligned"), width)).alias("record"))


def blocks(wide: DataFrame, width: int = 60) -> DataFrame:
    """family, block, rank, line: the rows of each block, names padded five past the longest."""
    longest = wide.groupBy("family").agg(F.max(F.length("name")).alias("w"))
    count = F.ceil(F.length("aligned") / width).cast("int")
    cut = wide.join(longest, "family").select("family", "rank", "name", "w", "aligned", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).alias("block"))
    return cut.select("family", "block", "rank", F.concat(F.expr("rpad(name, w + 5, ' ')"), F.col("aligned").substr(F.col("block") * width + 1, F.lit(width))).alias("line"))


def _text(rows: DataFrame, order: list[str], line: str, head: Column, tail: str = "\n") -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct(*order, line)))
    return rows.groupBy("family").agg(F.concat(head, F.array_join(F.transform(cells, lambda c: c[line]), "\n"), F.lit(tail)).alias("text"))


def fasta_text(wide: DataFrame, width: int = 60) -> DataFrame:
    return _text(fasta(wide, width), ["rank"], "record", F.lit(""))


def _spaced(rows: DataFrame) -> DataFrame:
    """Blocks with a blank line after each."""
    last = rows.groupBy("family").agg(F.max("rank").alias("last"))
    return rows.join(last, "family").withColumn("line", F.when(F.col("rank") == F.col("last"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")))


def clustal_text(wide: DataFrame, width: int = 60, title: str = "multiple sequence alignment") -> DataFrame:
    return _text(_spaced(blocks(wide, width)), ["block", "rank"], "line", F.lit(f"{title}\n\n\n"), "")


def msf_header(wide: DataFrame) -> DataFrame:
    """family, rank, line, check: the Name lines with each row's checksum."""
    check = gcg_checksum("aligned")
    return wide.select("family", "rank", check.alias("check"), F.concat(F.lit(" Name: "), "name", F.lit("  Len:  "), F.length("aligned").cast("string"), F.lit("  Check: "), check.cast("string"), F.lit("  Weight:  1.00")).alias("line"))


def msf_checksum(wide: DataFrame) -> DataFrame:
    return msf_header(wide).groupBy("family").agg((F.sum("check") % 10000).alias("check"))


def msf_text(wide: DataFrame, kind: str = "P", width: int = 50) -> DataFrame:
    head = _text(msf_header(wide), ["rank"], "line", F.lit("")).withColumnRenamed("text", "names")
    body = _text(_spaced(blocks(wide, width)), ["block", "rank"], "line", F.lit(""), "").withColumnRenamed("text", "body")
    size = wide.groupBy("family").agg(F.max(F.length("aligned")).alias("n"))
    banner = F.lit("!!AA_MULTIPLE_ALIGNMENT 1.0\n\n" if kind == "P" else "!!NA_MULTIPLE_ALIGNMENT 1.0\n\n")
    first = F.concat(banner, F.lit(" MSF: "), F.col("n").cast("string"), F.lit(f"  Type: {kind}  Check: "), F.col("check").cast("string"), F.lit("  ..\n\n"))
    return head.join(body, "family").join(size, "family").join(msf_checksum(wide), "family").select("family", F.concat(first, "names", F.lit("\n//\n\n"), "body").alias("text"))


def stockholm_text(wide: DataFrame, pp: DataFrame | None = None, pp_cons: DataFrame | None = None) -> DataFrame:
    """pp: family, rank, pp, unless the rows have a column pp; pp_cons: family, pp_cons."""
    rows = wide.join(pp, ["family", "rank"], "left") if pp is not None else wide if "pp" in wide.columns else wide.withColumn("pp", F.lit(None).cast("string"))
    line = F.concat("name", F.lit(" "), "aligned", F.coalesce(F.concat(F.lit("\n#=GR "), "name", F.lit(" PP "), "pp"), F.lit("")))
    body = _text(rows.withColumn("line", line), ["rank"], "line", F.lit("# STOCKHOLM 1.0\n\n"), "")
    if pp_cons is not None:
        body = body.join(pp_cons, "family", "left").select("family", F.concat("text", F.coalesce(F.concat(F.lit("\n#=GC PP_cons "), "pp_cons"), F.lit(""))).alias("text"))
    return body.withColumn("text", F.concat("text", F.lit("\n//\n")))


def phylip_text(wide: DataFrame) -> DataFrame:
    """Sequential PHYLIP, names cut or padded to ten."""
    size = wide.groupBy("family").agg(F.concat(F.count("*").cast("string"), F.lit(" "), F.max(F.length("aligned")).cast("string"), F.lit("\n")).alias("head"))
    body = _text(wide.withColumn("line", F.concat(F.rpad("name", 10, " "), "aligned")), ["rank"], "line", F.lit(""))
    return body.join(size, "family").select("family", F.concat("head", "text").alias("text"))


def phylip_blocks(wide: DataFrame, width: int = 60) -> DataFrame:
    """Interleaved PHYLIP: the first block with names, the others without, a blank line between them."""
    size = wide.groupBy("family").agg(F.concat(F.count("*").cast("string"), F.lit(" "), F.max(F.length("aligned")).cast("string"), F.lit("\n")).alias("head"))
    count = F.ceil(F.length("aligned") / width).cast("int")
    cut = wide.select("family", "rank", "name", "aligned", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).alias("block"))
    part = F.col("aligned").substr(F.col("block") * width + 1, F.lit(width))
    rows = cut.select("family", "block", "rank", F.when(F.col("block") == 0, F.concat(F.rpad("name", 10, " "), part)).otherwise(part).alias("line"))
    body = _text(_spaced(rows), ["block", "rank"], "line", F.lit(""), "")
    return body.join(size, "family").select("family", F.concat("head", "text").alias("text"))


def tasks_csv(tree: DataFrame, path: str) -> None:
    """Merge tasks a, b, c, p, n as lines of text, in the order of c."""
    tree.select("a", "b", "c", "p", "n").coalesce(1).sortWithinPartitions("c").write.csv(path)  # one tree's tasks


def results(rows: DataFrame, path: str) -> None:
    """Results as JSON and CSV in two folders of path."""
    rows.write.json(f"{path}/json")
    rows.write.option("header", True).csv(f"{path}/csv")


def to_lists(wide: DataFrame) -> dict[str, list[str]]:
    """Each family's rows of text in order, on the driver: for alignments that fit there."""
    out: dict[str, list[str]] = {}
    for r in wide.select("family", "rank", "aligned").orderBy("family", "rank").toLocalIterator():
        out.setdefault(r["family"], []).append(r["aligned"])
    return out


def to_biopython(wide: DataFrame, family: str):
    """One family as a Bio.Align.MultipleSeqAlignment, where Biopython is installed."""
    from Bio.Align import MultipleSeqAlignment
    from Bio.Seq import Seq
    from Bio.SeqRecord import SeqRecord

    rows = wide.filter(F.col("family") == family).orderBy("rank").collect()  # one family
    return MultipleSeqAlignment([SeqRecord(Seq(r["aligned"]), id=r["name"]) for r in rows])


def to_skbio(wide: DataFrame, family: str):
    """One family as a skbio TabularMSA, typed by its letters, where scikit-bio is installed."""
    import skbio

    from seqloom.functions.encode import infer_type

    rows = wide.filter(F.col("family") == family).orderBy("rank").withColumn("kind", infer_type(F.col("aligned"))).collect()  # one family
    kinds = {r["kind"] for r in rows}
    kind = skbio.Protein if "protein" in kinds else skbio.RNA if "RNA" in kinds else skbio.DNA
    return skbio.TabularMSA([kind(r["aligned"], metadata={"id": r["name"]}) for r in rows])


WRITERS = {"phylip-interleaved": phylip_blocks, "fasta": fasta_text, "clustal": clustal_text, "msf": msf_text, "stockholm": stockholm_text, "phylip": phylip_text}


def write(wide: DataFrame, path: str, kind: str = "fasta") -> None:
    """A text file for each family, under path/family=.../; kind is a format or one of its short names."""
    text = WRITERS[FORMATS[kind]](wide)
    text.select("family", F.regexp_replace("text", "\n$", "").alias("text")).write.partitionBy("family").text(path)


def site_weights(columns: DataFrame) -> DataFrame:
    """family, col, line: confidences held to [0, 1], six places."""
    return columns.select("family", "col", F.format_string("%.6f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))).alias("line"))


def poar_bytes(pairs: list[tuple[int, int, int, int, int]], n_sequences: int, n_runs: int) -> bytes:
    """Binary support table of one family: rows (i, j, pos_i, pos_j, mask), i < j."""
    out = [b"POAR", struct.pack("<iii", 1, n_sequences, n_runs)]
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j, a, b, mask in pairs:
        held.setdefault((i, j), []).append((a << 20 | b, mask))
    for i in range(n_sequences):
        for j in range(i + 1, n_sequences):
            rows = sorted(held.get((i, j), []))
            out.append(struct.pack("<i", len(rows)))
            out += [struct.pack("<II", *r) for r in rows]
    return b"".join(out)


def poar_rows(raw: bytes) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    if raw[:4] != b"POAR":
        raise ValueError("not a support table")
    version, n, runs = struct.unpack_from("<iii", raw, 4)
    if version != 1:
        raise ValueError(f"support table of version {version}")
    at, out = 16, []
    for i in range(n):
        for j in range(i + 1, n):
            (m,) = struct.unpack_from("<i", raw, at)
            at += 4
            for _ in range(m):
                key, mask = struct.unpack_from("<II", raw, at)
                at += 8
                out.append((i, j, key >> 20, key & (1 << 20) - 1, mask))
    return out, n, runs
