"""The functions most users need, and a command line: python -m seqloom.api align -i in.fasta -o out --mode fast.

Here input is checked: blank sequences, digits, control characters, families of one and files of no known format are
errors, raised when a result is read.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.align import MODES, Options
from seqloom.operators import align as _align
from seqloom.operators import clean
from seqloom.operators import compare as _compare
from seqloom.operators import evaluation as _evaluation
from seqloom.operators.columns import alignment_stats, column_consensus, pairwise_identity, remove_gap_columns, trim
from seqloom.operators.longform import dealign
from seqloom.sources import catalog, sinks, text

__all__ = ["evaluate_folder", "get_num_threads", "set_num_threads", "support", "align", "align_path", "align_to_path", "alignment_stats", "column_consensus", "compare", "compare_detailed", "generate", "pairwise_identity", "read", "reformat", "remove_gap_columns", "trim", "write"]

generate, write = _align.generate, sinks.write


def align(seqs: DataFrame, mode: str = "default", load_support: DataFrame | None = None, **changes) -> DataFrame:
    """family, run_id, rank, name, aligned from family, rank, name, seq.

    load_support: a saved support table (see support), from which a consensus at min_support is made without aligning.
    """
    rows = clean.checked(seqs)
    if load_support is not None:
        return _align.consensus_from_support(rows, load_support, changes.get("min_support") or 1)
    return _align.align(rows, mode, **changes)


def support(seqs: DataFrame, runs: int = 3, seed: int = 42) -> DataFrame:
    """family, i, j, pos_i, pos_j, mask of an ensemble's runs, to be saved as a table of any format Spark writes."""
    from seqloom.operators import pairs

    return pairs.support(_align.align_runs(clean.checked(seqs), runs, seed))


def align_path(spark: SparkSession, path: str, mode: str = "default", **changes) -> DataFrame:
    """Files under a path, a family each, of any format that is recognised; gaps are taken out first."""
    got = read(spark, path, "auto")
    return align(got.select("family", "rank", text.short_name("name").alias("name"), dealign(got["aligned"]).alias("seq")), mode, **changes)


def get_num_threads(spark: SparkSession) -> int:
    """Tasks that run at once."""
    return spark.sparkContext.defaultParallelism


def set_num_threads(spark: SparkSession, n: int) -> None:
    """Tasks that a shuffle makes; results do not depend on it."""
    spark.conf.set("spark.sql.shuffle.partitions", str(max(1, n)))


def read(spark: SparkSession, path: str, kind: str = "fasta") -> DataFrame:
    """family (the file), rank, name, aligned from text files of one format, or 'auto': of the format each file shows."""
    if kind == "auto":
        return text.read_any(spark, path).withColumnRenamed("path", "family").select("family", "rank", "name", "aligned")
    whole = text.files(spark, path)
    if kind == "fasta":
        out = text.fasta(whole, strict=True)
    else:
        out = {"clustal": text.clustal, "msf": text.msf, "stockholm": text.stockholm}[kind](text.lines(whole))
    return out.withColumnRenamed("path", "family").select("family", "rank", "name", "aligned")


def align_to_path(spark: SparkSession, source: str, target: str, mode: str = "default", kind: str = "fasta", **changes) -> None:
    write(align_path(spark, source, mode, **changes), target, kind)


def compare(ref: DataFrame, test: DataFrame) -> DataFrame:
    """family, sp.  Rows are matched by name; a name on one side alone is an error."""
    return _compare.sum_of_pairs(*_compare.by_name(ref, test))


def compare_detailed(ref: DataFrame, test: DataFrame, most_gaps: float = -1.0, mask: DataFrame | None = None) -> DataFrame:
    """As compare: family, recall, precision, f1, tc, ref_pairs, test_pairs, common."""
    a, b = _compare.by_name(ref, test)
    return _compare.detailed(a, b, most_gaps, mask)


def reformat(rows: DataFrame, path: str, kind: str = "fasta", rename: bool = False, unalign: bool = False, clean_up: bool = False) -> None:
    """Writes rows in another format; clean_up: rows without residues go, names that occur again get a suffix."""
    out = rows
    if clean_up:
        out = clean.duplicate_names(out.withColumn("seq", dealign(out["aligned"])).filter("seq <> ''")).drop("seq")
    out = clean.rename(out) if rename else out
    if unalign:
        out = out.withColumn("aligned", dealign(out["aligned"]))
    write(out, path, kind)


def evaluate_folder(spark: SparkSession, folder: str, methods: list[str], most: int, target: str) -> None:
    """Aligns the cases of a folder (files of one stem beside each other) by each method and writes their scores and the
    table of means by category."""
    cases = catalog.first_cases(catalog.beside(catalog.paths(spark, folder), "cases"), most)
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    whole = text.files(spark, folder, deep=True).withColumn("path", plain(F.col("path")))

    def own(column: str) -> DataFrame:
        """The cases' files of one kind, by family."""
        at = cases.select("family", plain(F.col(column)).alias("path"))
        return text.parse_any(whole.join(at, "path", "left_semi")).join(at, "path").select("family", "rank", "name", "aligned")

    seqs, ref = own("unaligned"), own("reference")
    seqs = seqs.select("family", "rank", text.short_name("name").alias("name"), dealign(seqs["aligned"]).alias("seq"))
    got = _evaluation.evaluate(seqs, ref, methods).join(cases.select("family", "dataset"), "family")
    sinks.results(got, f"{target}/scores")
    sinks.results(_evaluation.category_table(got), f"{target}/means")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="seqloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("align")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--output", required=True)
    a.add_argument("--format", default="fasta", choices=sorted(sinks.FORMATS))
    a.add_argument("--mode", default="default", choices=sorted(MODES))
    a.add_argument("-n", "--nthreads", type=int, default=0)
    a.add_argument("-q", "--quiet", action="store_true")
    a.add_argument("--save-poar", help="Parquet folder for the support table of the ensemble's runs")
    a.add_argument("--load-poar", help="such a folder, to take a consensus from")
    for f in fields(Options):
        kind = type(f.default)
        a.add_argument("--" + f.name.replace("_", "-"), type=kind, default=None)
    r = sub.add_parser("reformat")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-o", "--output", required=True)
    r.add_argument("--from", dest="source", default="fasta", choices=["auto", "fasta", "clustal", "msf", "stockholm"])
    r.add_argument("--format", default="fasta", choices=sorted(sinks.FORMATS))
    r.add_argument("--changename", action="store_true")
    r.add_argument("--unalign", action="store_true")
    r.add_argument("--clean", action="store_true")
    e = sub.add_parser("evaluate", help="align the cases of a catalogue by several methods and score them")
    e.add_argument("-i", "--input", required=True, help="folder with unaligned files and their references")
    e.add_argument("-o", "--output", required=True)
    e.add_argument("--methods", default="fast", help="comma-joined, of " + ", ".join(_evaluation.METHODS))
    e.add_argument("--max-cases", type=int, default=0)
    s = sub.add_parser("scan", help="align every FASTA file of a folder and report widths and times")
    s.add_argument("-i", "--input", required=True)
    s.add_argument("--mode", default="fast")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "align":
        given = {f.name: getattr(args, f.name) for f in fields(Options) if getattr(args, f.name) is not None}
        if args.quiet:
            spark.sparkContext.setLogLevel("ERROR")
        if args.nthreads:
            set_num_threads(spark, args.nthreads)
        if args.load_poar:
            given["load_support"] = spark.read.parquet(args.load_poar)
        align_to_path(spark, args.input, args.output, args.mode, args.format, **given)
        if args.save_poar:
            got = read(spark, args.input, "auto")
            seqs = got.select("family", "rank", text.short_name("name").alias("name"), dealign(got["aligned"]).alias("seq"))
            support(seqs, given.get("ensemble") or MODES[args.mode].ensemble or 1, given.get("seed", 42)).write.parquet(args.save_poar)
    elif args.command == "reformat":
        reformat(read(spark, args.input, args.source), args.output, args.format, args.changename, args.unalign, args.clean)
    elif args.command == "evaluate":
        evaluate_folder(spark, args.input, args.methods.split(","), args.max_cases, args.output)
    else:
        _evaluation.families_in(spark, args.input, args.mode).show(1000, False)


if __name__ == "__main__":
    main()
