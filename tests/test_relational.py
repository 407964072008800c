"""Relational operators on small literals; the registered queries are held against SQL in test_queries."""

import pytest
from pyspark.sql import functions as F

from seqloom import api
from seqloom.functions import encode as E
from seqloom.operators import align, calibration, clean, columns, compare, longform, pairs
from seqloom.sources import sinks, text


def wide(spark, rows, family="f"):
    return spark.createDataFrame([(family, 0, i, f"n{i}", r) for i, r in enumerate(rows)], "family string, run_id int, rank long, name string, aligned string")


def aligned(df):
    return [r.aligned for r in df.orderBy("rank").collect()]


def test_stats(spark):
    r = columns.alignment_stats(wide(spark, ["ATCG", "ATCG", "ATGG"])).first()
    assert (r.length, r.n_sequences, r.conservation) == (4, 3, 0.75) and r.identity == pytest.approx(10 / 12)
    assert columns.column_consensus(wide(spark, ["ATCG", "ATCG", "ATGG"])).first().consensus == "ATCG"
    assert aligned(columns.remove_gap_columns(wide(spark, ["AT-G"] * 3))) == ["ATG"] * 3
    assert aligned(columns.remove_gap_columns(wide(spark, ["---"] * 2))) == ["", ""]
    assert aligned(columns.trim(wide(spark, ["ATCGATCG"]), 2, 6)) == ["CGAT"]
    assert aligned(columns.trim(wide(spark, ["ATCGATCG"]), 2, -1)) == ["CGATC"]


def test_mask(spark):
    w = wide(spark, ["ABCD", "EFGH"])
    conf = spark.createDataFrame([("f", i, c) for i, c in enumerate([0.9, 0.3, 0.8, 0.2])], "family string, col long, confidence double")
    got = pairs.confidence_mask(w, conf, 0.5)
    assert aligned(got) == ["AC", "EG"] and got.first().n_kept == 2
    assert aligned(pairs.confidence_mask(w, conf, 0.95)) == ["", ""]


def test_site_weights(spark):
    conf = spark.createDataFrame([("f", i, c) for i, c in enumerate([0.95, 0.3, 1.5, -0.1])], "family string, col long, confidence double")
    assert [r.line for r in sinks.site_weights(conf).orderBy("col").collect()] == ["0.950000", "0.300000", "1.000000", "0.000000"]


def test_compare_with_itself(spark):
    w = wide(spark, ["AC-GT", "ACCGT", "A--GT"])
    r = compare.detailed(w, w).first()
    assert (r.recall, r.precision, r.f1, r.tc) == (1, 1, 1, 1) and r.ref_pairs == r.test_pairs == r.common
    assert compare.sum_of_pairs(w, w).first().sp == 100
    flat = wide(spark, ["ACGT", "ACGT"])
    assert compare.sum_of_pairs(flat, flat).first().sp == 100


def test_calibration(spark):
    cases = lambda p, a: spark.createDataFrame([("m", float(x), y) for x, y in zip(p, a, strict=True)], "method string, predicted double, actual int")
    assert calibration.brier(cases([1, 0, 1], [1, 0, 1])).first().brier == 0
    assert calibration.brier(cases([1, 1], [0, 0])).first().brier == 1
    assert calibration.brier(cases([0.5] * 4, [1, 0, 1, 0])).first().brier == 0.25
    assert calibration.expected_calibration_error(cases([1, 1], [1, 1])).first().ece == 0
    assert calibration.calibration_curve(cases([0.1, 0.9], [0, 1]), 5).count() == 5


def test_holm(spark):
    t = spark.createDataFrame([("g", 1, 0.01), ("g", 2, 0.04), ("g", 3, 0.03)], "grp string, id int, p double")
    assert [round(r.adjusted, 9) for r in calibration.holm(t).orderBy("id").collect()] == [0.03, 0.06, 0.06]


def test_wilcoxon_by_hand(spark):
    t = spark.createDataFrame([("a", "b", str(i), x, y) for i, (x, y) in enumerate([(3.0, 1.0), (2.0, 3.0), (5.0, 1.0), (1.0, 1.0), (4.0, 3.0)])], "a string, b string, family string, x double, y double")
    r = calibration.wilcoxon(t).first()
    assert (r.n, r.w) == (4, 1.5) and 0 < r.p <= 1


def test_fasta_reader(spark):
    whole = spark.createDataFrame([("p", ">a one\nAC-GT\nac.g\n>b\n\n>c\nGG*T 1\r\n"), ("q", "no record")], "path string, content string")
    got = [(r.rank, r.name, r.aligned, r.seq) for r in text.fasta(whole).orderBy("rank").collect()]
    assert got == [(0, "a one", "AC-GTac-g", "ACGTacg"), (1, "b", "", ""), (2, "c", "GG-T", "GGT")]


@pytest.mark.parametrize("kind", ["fasta", "clustal", "msf", "stockholm"])
def test_formats_round_trip(spark, tmp_path, kind):
    w = wide(spark, ["ACGT" * 40 + "-" * 7, "-" * 7 + "TTTT" * 40, "G" + "-" * 166])
    api.write(w, f"{tmp_path}/{kind}", kind)
    got = api.read(spark, f"{tmp_path}/{kind}/family=f", kind).orderBy("rank").collect()
    assert [(r.name, r.aligned) for r in got] == [(r.name, r.aligned) for r in w.orderBy("rank").collect()]


def test_sniff(spark):
    whole = spark.createDataFrame([("a", ">x\nAC"), ("b", "CLUSTAL W (1.8)\n\nx AC"), ("c", "!!AA_MULTIPLE_ALIGNMENT\n MSF: 3\n//"), ("d", "plain prose")], "path string, content string")
    got = {r.path: r.format for r in text.sniff(text.lines(whole)).collect()}
    assert got == {"a": "fasta", "b": "clustal", "c": "msf", "d": None}


def test_tables_of_other_tools(spark):
    whole = spark.createDataFrame([("p", "# c\nhit1 - q - 1e-5 33.2 x\nbroken - q - oops 1\nshort row")], "path string, content string")
    assert [(r.name, r.e_value, r.score) for r in text.hit_table(text.lines(whole)).collect()] == [("hit1", 1e-5, 33.2)]
    xml = spark.createDataFrame([("p", "<x><colsco-data> 1 0\n1 </colsco-data></x>"), ("q", "<x/>")], "path string, content string")
    assert [(r.col, r.mask) for r in text.column_mask(xml).orderBy("col").collect()] == [(0, 1), (1, 0), (2, 1)]


def test_support_codec():
    rows = [(0, 1, 0, 0, 3), (0, 1, 1, 2, 1), (1, 2, 4, 4, 2)]
    assert sinks.poar_rows(sinks.poar_bytes(rows, 3, 2)) == (rows, 3, 2)
    with pytest.raises(ValueError):
        sinks.poar_rows(b"NOPE")


def test_strings(spark):
    df = spark.createDataFrame([("ATGGCCTAAXX", "AC-G--T")], "dna string, a string")
    r = df.select(
        E.translate_dna(F.col("dna")).alias("p"), longform.finalise(longform.dealign(F.col("a")), longform.gap_vector(F.col("a"))).alias("again"),
        E.infer_type(F.col("a")).alias("t"), E.back_translate(F.lit("M-A"), F.lit("ATGGCC")).alias("c"), E.letters(F.lit("ACGTUN"), "dna5").alias("l"),
    ).first()
    assert (r.p, r.again, r.t, r.c, r.l) == ("MA", "AC-G--T", "DNA", "ATG---GCC", "abcdde")
    assert [pairs.pp_char(F.lit(v)) is not None for v in (0.1,)] == [True]


def test_clean(spark):
    s = spark.createDataFrame([("f", 0, "a", "ACGT"), ("f", 1, "a", ""), ("f", 2, "b", "AC1"), ("f", 3, "c", None)], "family string, rank long, name string, seq string")
    assert clean.drop_empty(s).count() == 2
    assert {(r.rank, r.problem) for r in clean.invalid(s).collect()} == {(1, "blank"), (2, "digit"), (3, "blank")}
    assert sorted(r.name for r in clean.duplicate_names(s).collect()) == ["a_1", "a_2", "b", "c"]
    assert sorted(r.place for r in clean.shuffle(s, 1).collect()) == [0, 1, 2, 3]


def test_align_and_consensus(spark):
    s = align.generate(spark, 3, 8, 40)
    out = align.align(s, "default")
    got = out.join(s, ["family", "rank", "name"])
    assert got.filter(longform.dealign(F.col("aligned")) != F.col("seq")).count() == 0
    assert out.groupBy("family").agg(F.countDistinct(F.length("aligned")).alias("n")).filter("n > 1").count() == 0
    made = align.align_runs(s, 3)
    rows = align.consensus_from_support(s, pairs.support(made), 2)
    assert rows.join(s, ["family", "rank"]).filter(longform.dealign(F.col("aligned")) != F.col("seq")).count() == 0
    other = align.align(s.repartition(7), "default")
    assert out.exceptAll(other).count() == 0
    with pytest.raises(ValueError):
        align.options("nope")


def test_command_line(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">a\nGATTACA\n>b\nGATTA\n")
    api.main(["align", "-i", f"{tmp_path}/in.fasta", "-o", f"{tmp_path}/out", "--mode", "fast", "--refine", "all"])
    files = list((tmp_path / "out").rglob("part-*"))
    assert files and "GATTACA" in files[0].read_text()


def test_stream(spark, tmp_path):
    from seqloom.streaming.incremental import align_each_batch, read_fasta

    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.fasta").write_text(">a\nGATTACA\n>b\nGATTA\n")
    rows = text.fasta(read_fasta(spark, f"{tmp_path}/in")).withColumnRenamed("path", "family")
    align_each_batch(rows, f"{tmp_path}/out", checkpoint=f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
