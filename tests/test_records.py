"""Record formats and trees on small literals."""

import pytest

from seqloom.operators import trees
from seqloom.sources import records, text


def frame(spark, content):
    return spark.createDataFrame([("p", content)], "path string, content string")


@pytest.mark.parametrize(
    ("kind", "content"),
    [
        ("genbank", "LOCUS       AB1  12 bp\nDEFINITION x\nORIGIN\n        1 acgt acgt\n        9 ac\n//\nLOCUS AB2\nORIGIN\n 1 ttt\n//\n"),
        ("embl", "ID   AB1; SV 1; linear\nSQ   Sequence 10 BP;\n     acgtacgtac        10\n//\nID   AB2;\nSQ   Sequence 3 BP;\n     ttt 3\n//\n"),
        ("swiss", "ID   AB1   Reviewed; 10 AA.\nSQ   SEQUENCE 10 AA;\n     ACGTACGTAC\n//\nID   AB2 X\nSQ   SEQUENCE 3 AA;\n     TTT\n//\n"),
    ],
)
def test_entries(spark, kind, content):
    got = [(r.rank, r.name, r.seq) for r in records.entries(frame(spark, content), kind).orderBy("rank").collect()]
    assert got == [(0, "AB1", "ACGTACGTAC"), (1, "AB2", "TTT")]


def test_phylip(spark):
    got = [(r.rank, r.name, r.aligned) for r in records.phylip(frame(spark, " 2 6\nseq1      AC-GTA\nseq2      ACG GTA\n")).orderBy("rank").collect()]
    assert got == [(0, "seq1", "AC-GTA"), (1, "seq2", "ACGGTA")]


def test_score_files(spark):
    lines = text.lines(frame(spark, "#COL SCORE\n1 0.5\n2 x\n3 0.9\n"))
    assert [(r.col, r.confidence) for r in records.column_scores(lines).orderBy("col").collect()] == [(0, 0.5), (2, 0.9)]
    lines = text.lines(frame(spark, "COL ROW\n1 2 0.25\n"))
    assert [tuple(r)[1:] for r in records.residue_scores(lines).collect()] == [(0, 1, 0.25)]
    lines = text.lines(frame(spark, "site class\n1 0\n2 2\n"))
    assert [(r.site, r.selected) for r in records.site_classes(lines, 2).orderBy("site").collect()] == [(1, 0), (2, 1)]


def test_trees(spark):
    x = spark.createDataFrame([("f", 0, 1, 5), ("f", 2, 3, 6), ("f", 5, 6, 7), ("f", 7, 4, 8)], "family string, a int, b int, c int")
    y = spark.createDataFrame([("f", 0, 2, 5), ("f", 1, 3, 6), ("f", 5, 6, 7), ("f", 7, 4, 8)], "family string, a int, b int, c int")
    leaves = spark.createDataFrame([("f", i) for i in range(5)], "family string, leaf int")
    rx, ry = trees.members(x, leaves), trees.members(y, leaves)
    assert rx.filter("node = 8").count() == 5
    sx = trees.splits(rx)
    assert sorted(r.split for r in sx.collect()) == [[2, 3], [2, 3, 4]]
    assert trees.robinson_foulds(sx, sx).first().distance == 0
    assert trees.robinson_foulds(sx, trees.splits(ry)).first().distance == 1
    w = {r.leaf: r.weight for r in trees.leaf_weights(x, rx).collect()}
    assert w[4] == pytest.approx(4.0) and w[0] == pytest.approx(0.25) and sum(w.values()) == pytest.approx(5)
