"""Kernels against plain versions, checks that raise, catalogues, evaluation of methods."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom import api
from seqloom.functions import align as K
from seqloom.functions import newick, trees
from seqloom.functions.encode import back_translate, translate_dna
from seqloom.functions.kernels import infix_distance, infix_distance_many
from seqloom.functions.rng import Random
from seqloom.functions.scoring import PROTEIN, matrix_file, scores_for, type_for
from seqloom.operators import align as A
from seqloom.operators import calibration, clean, columns, compare, evaluation, pairs
from seqloom.operators import trees as T
from seqloom.sources import catalog, text


def rows(spark, family, seqs, column="seq"):
    return spark.createDataFrame([(family, i, f"s{i}", s) for i, s in enumerate(seqs)], f"family string, rank long, name string, {column} string")


# ---- kernels ----


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=150), st.text("abcd", max_size=140)), max_size=12))
def test_many_edit_distances(some):
    texts, patterns = [a for a, _ in some], [b for _, b in some]
    assert infix_distance_many(texts, patterns).tolist() == [infix_distance(a, b) for a, b in some]


@pytest.mark.parametrize("cells", [40, 400])
def test_blocks_of_rows_change_nothing(monkeypatch, cells):
    rng = np.random.default_rng(cells)
    some = [(rng.integers(-4, 8, (int(rng.integers(1, 30)), int(rng.integers(1, 30)))).astype(np.float32), scores_for(k)) for k in ("protein", "dna", "rna") for _ in range(12)]
    pairs_ = [K.Pair(*x.shape, lambda i, j, x=x: x[i:j], s) for x, s in some]
    whole = [(p.tolist(), q.tolist(), t) for p, q, t in K.align_pairs(pairs_)]
    monkeypatch.setattr(K, "CELLS", cells)
    assert [(p.tolist(), q.tolist(), t) for p, q, t in K.align_pairs(pairs_)] == whole


def test_meetings_lie_on_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = (int(v) for v in rng.integers(2, 20, 2))
        x = rng.integers(-4, 8, (n, m)).astype(np.float32)
        pair = K.Pair(n, m, lambda i, j, x=x: x[i:j], scores_for("protein"))
        ((p, q, total),) = K.align_pairs([pair])
        row = int(rng.integers(1, n))
        got = K.meeting(pair, row)
        assert got.margin >= -1e-3 and 0 <= got.column <= m
        if got.margin > 1e-3:  # the one best crossing is the path's
            at = int(np.flatnonzero(p == row - 1)[0])
            ahead = q[at + 1 :][q[at + 1 :] >= 0]
            nxt = np.flatnonzero(p[at + 1 :] >= 0)
            over = q[at + 1 : at + 1 + (nxt[0] if len(nxt) else 0)]
            column = (int(ahead[0]) if len(ahead) else m)
            assert got.column in range(column, column + int((over >= 0).sum()) + 1)
        left, right = K.through(pair, [(row, got.other)])
        assert left[left >= 0].tolist() == list(range(n)) and right[right >= 0].tolist() == list(range(m))


def plain_merge_score(x, y, s, letters):
    """Every pair of a member of x and a member of y, column by column; gap runs and ends are those of the path."""
    width = len(x[0])
    gap_x = [all(r[c] == "+" for r in x) for c in range(width)]
    gap_y = [all(r[c] == "+" for r in y) for c in range(width)]
    both = [c for c in range(width) if not gap_x[c] and not gap_y[c]]
    total, code = 0.0, {c: i for i, c in enumerate(letters)}
    for a, b in itertools.product(x, y):
        for c in range(width):
            inner = both and both[0] < c < both[-1]
            if a[c] in code and b[c] in code:
                total += s.matrix[code[a[c]], code[b[c]]]
            elif gap_x[c] and b[c] in code or gap_y[c] and a[c] in code:
                total -= s.gap_extend if inner else s.gap_terminal
        for c in range(width):
            kind = 1 if gap_x[c] else 2 if gap_y[c] else 0
            before = 0 if not c else 1 if gap_x[c - 1] else 2 if gap_y[c - 1] else 0
            if kind and kind != before and both and both[0] < c < both[-1]:
                total -= s.gap_open
    return total


def test_merge_score_against_every_pair():
    s = scores_for("dna")
    seqs = ["ACGTACGT", "ACGACGT", "ACGTTACGT", "CGTACG"]
    codes = [s.codes(x) for x in seqs]
    leaves = [K.leaf(i, c, len(s.letters)) for i, c in enumerate(codes)]
    x, y = K.merge(leaves[0], leaves[1], s, 0.0)[0], K.merge(leaves[2], leaves[3], s, 0.0)[0]
    ((p, q, _),) = K.align_pairs([K.side_by_side(x, y, s, 0.0)])
    cells = lambda side, at: ["".join("+" if k < 0 else seqs[m][row[k]] if row[k] >= 0 else "-" for k in at.tolist()) for m, row in zip(side.members, side.grid, strict=True)]
    assert K.merge_score(x, y, p, q, s) == pytest.approx(plain_merge_score(cells(x, p), cells(y, q), s, s.letters))


@pytest.mark.parametrize("o", [K.Options(refine="inline"), K.Options(refine="inline", adaptive_budget=True), K.Options(gap_scale=0.5), K.Options(vsm_amax=1.0), K.Options(rebalance=4.0), K.Options(kind="divergent"), K.Options(kind="pfasum_auto", consistency=3)])
def test_options_keep_the_sequences(o):
    seqs = K.generate_family(11, 45, 5)
    got = K.align_family([f"s{i}" for i in range(11)], seqs, o)
    assert len({len(r) for r in got}) == 1 and [r.replace("-", "") for r in got] == seqs
    assert K.budget([1, 1, 0.1, 1], True) == 1 + round(7 / 4) and K.budget([1.0], False) == 3
    assert K.gap_factor(0.0, 1.0) == 1 and K.gap_factor(5.0, 1.0) == 0.3


def test_true_alignments():
    made = K.generate_alignment(30, 40, 7)
    assert len({len(r) for r in made}) == 1 and [r.replace("-", "") for r in made] == K.generate_family(30, 40, 7)
    assert all(any(r[c] != "-" for r in made) for c in range(len(made[0])) if any(r[c] != "-" for r in made))


def test_types(tmp_path):
    protein, dna = ["MKTAYIAKQRQISFVK"], ["ACGTACGTACGT"]
    assert (type_for("", protein), type_for("", dna), type_for("divergent", dna), type_for("dna", dna)) == ("protein", "rna", "rna", "dna")
    assert type_for("pfasum_auto", protein * 2) == "pfasum43" and type_for("pfasum_auto", [*protein, "MKTAYIAK"]) == "pfasum60"
    for kind, seqs in (("rna", protein), ("internal", protein), ("protein", dna), ("plastic", dna)):
        with pytest.raises(ValueError):
            type_for(kind, seqs)
    rna = scores_for("rna")
    assert (rna.gap_open, rna.gap_extend, rna.gap_terminal) == (217.0, 39.4, 292.6) and rna.matrix[0, 0] == 374 and rna.matrix[4, 4] == 283
    table = "# a table\n  A R X\nA 4 -1 0\nR -1 5 0\nX 0 0 -1\n"
    (tmp_path / "m").write_text(table)
    got = matrix_file(str(tmp_path / "m"))
    assert got[PROTEIN.index("A"), PROTEIN.index("R")] == -1 and got[PROTEIN.index("W"), PROTEIN.index("W")] == -1 and got.shape == (23, 23)


def test_spread_anchors():
    seqs = ["A" * 30, "A" * 29 + "C", "C" * 30, "ACGT" * 7, "GGTT" * 7]
    far = trees.embed(seqs)
    x = far.mean(1) / np.array([len(s) for s in seqs])
    got = trees.spread_anchors(seqs, far, 3)
    assert got[0] == int(np.argmin(abs(x - x.mean()))) and len(set(got)) == 3
    assert got[1] == int(np.argmax(abs(x - x[got[0]]))) and trees.spread_anchors(seqs[:2], None, 3) == []


def test_more_random_numbers():
    r = Random(1)
    assert abs(np.mean([r.exponential(2) for _ in range(4000)]) - 2) < 0.15
    for shape in (0.5, 3.0):
        x = [r.gamma(shape, 2.0) for _ in range(4000)]
        assert abs(np.mean(x) - 2 * shape) < 0.25 and abs(np.var(x) - 4 * shape) < 1.5
    a, b = Random(9), Random(9)
    b.jump()
    assert a.bits() != b.bits()


# ---- checks that raise ----


def raises(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_checked_input(spark):
    for bad, words in (("ACG1", "has digits"), ("  ", "is empty"), ("AC\x01G", "control"), (None, "is empty")):
        raises(clean.checked(rows(spark, "f", ["ACGT", bad])), words)
    raises(api.align(rows(spark, "f", ["ACGT"]), "fast"), "fewer than two")
    assert api.align(rows(spark, "f", ["ACGT", "ACG"]), "fast").count() == 2
    assert clean.essential(rows(spark, "f", ["A", "", "C"])).select("rank").orderBy("rank").collect() == [(0,), (2,)]
    raises(clean.unique_names(rows(spark, "f", ["A", "C"]).withColumn("name", F.lit("x"))), "occurs again")
    raises(columns.trim(rows(spark, "f", ["ACGT"], "aligned"), 3, 2), "no columns")
    assert columns.trim(rows(spark, "f", ["ACGTAC"], "aligned"), -4, -1).first().aligned == "GTA"
    raises(spark.range(1).select(translate_dna(F.lit("ACGT"), strict=True)), "multiple of three")
    raises(spark.range(1).select(back_translate(F.lit("MK"), F.lit("ATG"))), "2 residues")
    assert [r.family for r in clean.mostly_short(rows(spark, "f", ["A", "C", "ACGT"])).collect()] == ["f"]


def test_comparison_by_name(spark):
    ref, test = rows(spark, "f", ["AC-G", "ACTG"], "aligned"), rows(spark, "f", ["ACTG-", "AC--G"], "aligned")
    test = test.withColumn("name", F.when(F.col("rank") == 0, "s1").otherwise("s0"))
    got = api.compare_detailed(ref, test).first()
    assert (got.common, got.ref_pairs) == (2, 3)
    raises(api.compare(ref, test.withColumn("name", F.replace("name", F.lit("s1"), F.lit("x")))), "is not in the")
    raises(api.compare(ref, test.filter("rank = 0")), "is not in the test")
    mask = spark.createDataFrame([("f", 0, 1), ("f", 1, 1)], "family string, col long, mask int")
    raises(api.compare_detailed(ref, test, mask=mask), "mask of family f has 2 columns")
    # equal names are told apart by their checksums
    twice = spark.createDataFrame([("f", 0, "n", "AC"), ("f", 1, "n", "GT")], "family string, rank long, name string, aligned string")
    back = twice.withColumn("rank", 1 - F.col("rank"))
    assert api.compare(twice, back).first().sp == 100


def test_reading_any_format(spark, tmp_path):
    wide = rows(spark, "f", ["ACGT-", "AC-TT"], "aligned")
    for kind in ("fasta", "clustal", "msf"):
        api.write(wide, f"{tmp_path}/{kind}", kind)
        got = api.read(spark, f"{tmp_path}/{kind}/family=f", "auto").orderBy("rank")
        assert [(r.name, r.aligned) for r in got.collect()] == [("s0", "ACGT-"), ("s1", "AC-TT")]
    (tmp_path / "prose.txt").write_text("no record at all\n")
    raises(api.read(spark, f"{tmp_path}/prose.txt", "auto"), "no known format")
    (tmp_path / "one.fa").write_text(">a\nACGT\n")
    raises(api.read(spark, f"{tmp_path}/one.fa", "auto"), "fewer than two")
    (tmp_path / "early.fa").write_text("ACGT\n>a\nACGT\n>b\nAC\n")
    raises(api.read(spark, f"{tmp_path}/early.fa"), "before the first header")
    dna, protein = rows(spark, "f", ["ACGTACGT"]), rows(spark, "f", ["MKTAYIAKQRQISFVK"])
    assert [r.rank for r in text.union_of_one_kind(dna, dna).orderBy("rank").collect()] == [0, 1]
    raises(text.union_of_one_kind(dna, protein), "several alphabets")


# ---- trees ----


def test_newick():
    got, n = newick.splits("((a:1,b:2)x:0.5,('c d':1,(e:1,f:2):3):0.25);")
    assert n == 5 and (["c d", "e", "f"], 0.75) in got and (["e", "f"], 3.0) in got and (["b"], 2.0) in got
    with pytest.raises(ValueError):
        newick.read("((a,b)")
    for seed in range(5):
        made = newick.birth_death(9, seed=seed)
        assert newick.splits(made)[1] == 9 and newick.birth_death(9, seed=seed) == made


def test_tree_distances(spark):
    x, y = "((a:1,b:1):1,(c:1,(d:1,e:1):2):1);", "((a:1,c:1):1,(b:1,(d:1,e:1):1):1);"
    of = lambda t: T.newick_splits(spark.createDataFrame([("f", t)], "family string, newick string"))
    got = T.tree_distances(of(x), of(y)).first()
    # {a b} against {a c}: one split each alone, of length 1 + 1 as both of the root's edges part the leaves alike
    assert got.nrf == pytest.approx(2 / 4) and got.weighted == pytest.approx(2 + 2 + 1) and got.euclidean == pytest.approx((4 + 4 + 1) ** 0.5)
    assert T.tree_distances(of(x), of(x)).first().nrf == 0


def test_members_of_a_ladder(spark):
    """A tree as high as it has leaves takes rounds by its height's logarithm."""
    n = 300
    merges = [("f", 0 if not k else n + k - 1, k + 1, n + k) for k in range(n - 1)]
    tree = spark.createDataFrame(merges, "family string, a int, b int, c int")
    leaves = spark.createDataFrame([("f", k) for k in range(n)], "family string, leaf int")
    got = T.members(tree, leaves)
    sizes = {r.node: r["count"] for r in got.groupBy("node").count().collect()}
    assert sizes == {**dict.fromkeys(range(n), 1), **{n + k: k + 2 for k in range(n - 1)}}


# ---- relational pieces against plain versions ----


def test_kmer_diagonals(spark):
    r = random.Random(3)
    seqs = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(5)]
    seqs.append(seqs[0][10:50] + "ACGT")
    got = {(x.i, x.j): x.score for x in clean.kmer_diagonals(rows(spark, "f", seqs), 4).collect()}
    for i, j in itertools.combinations(range(6), 2):
        on = {}
        for a in range(len(seqs[i]) - 3):
            for b in range(len(seqs[j]) - 3):
                if seqs[i][a : a + 4] == seqs[j][b : b + 4]:
                    on[a - b] = on.get(a - b, 0) + 1
        assert got.get((i, j), 0) == max(on.values(), default=0)


def test_orders_and_trials(spark):
    held = spark.createDataFrame([("f", 0, 1, 0, 0, 3), ("f", 0, 1, 1, 1, 7), ("f", 0, 2, 0, 0, 7), ("f", 0, 1, 2, 2, 1)], "family string, i int, j int, pos_i int, pos_j int, mask int")
    assert [(r.i, r.j, r.pos_i) for r in pairs.merge_candidates(held, 2).orderBy("turn").collect()] == [(0, 1, 1), (0, 2, 0), (0, 1, 0)]
    tried = spark.createDataFrame([("f", 0, 1.0), ("f", 1, 3.0), ("f", 2, 3.0)], "family string, trial int, score double")
    assert tuple(pairs.best_trial(tried).first()) == ("f", 1, 3.0)
    maps = spark.createDataFrame([("f", 0, 0, 0, 5, 1.0), ("f", 1, 0, 2, 5, 0.5), ("f", 0, 1, 0, 7, 1.0), ("f", 1, 1, 2, 7, 1.0)], "family string, rank int, anchor int, pos int, anchor_pos int, confidence double")
    assert tuple(pairs.anchor_bonus(maps, 2, 2.0).first()) == ("f", 0, 1, 0, 2, 1.5)


def test_catalogues_of_files(spark, tmp_path):
    for name in ("set/RV11/BB1.tfa", "set/RV11/BB1.msf", "set/RV11/BBS1.tfa", "set/RV11/BBS1.msf", "set/RV20/BB2.tfa", "rna/tRNA/structural/a.fa", "rna/tRNA/unaligned/a.fasta", "rna/tRNA/unaligned/a.fa", "rna/U5/structural/b.fa", "rna/U5/unaligned/b.fasta"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = catalog.paths(spark, str(tmp_path))
    assert [(r.family, r.dataset) for r in catalog.beside(files, "set").collect()] == [("BB1", "set_RV11")]
    got = {(r.family, r.dataset, r.unaligned.rpartition("/")[2]) for r in catalog.in_folders(files, "rna", "unaligned", "structural", by_folder=True).collect()}
    assert got == {("a", "rna_tRNA", "a.fa"), ("b", "rna_U5", "b.fasta")}
    assert catalog.first_cases(catalog.in_folders(files, "rna", "unaligned", "structural"), 1).count() == 1


def test_evaluation(spark):
    true = A.generate_true(spark, 4, 6, 30)
    seqs = true.withColumn("seq", F.translate("aligned", "-", "")).drop("aligned")
    got = evaluation.evaluate(seqs, true, ["fast", "refined"]).collect()
    assert len(got) == 8 and all(r.error is None and 0 < r.recall <= 1 and 0 < r.sp <= 100 for r in got)
    want = {r.family: r.recall for r in compare.detailed(true, A.align(seqs, "fast")).collect()}
    assert {r.family: r.recall for r in got if r.method == "fast"} == pytest.approx(want)

    def broken(names, rows_):
        if len(rows_[0]) % 2:
            raise RuntimeError("no such tool")
        return rows_

    made = evaluation.run_cases(rows(spark, "odd", ["ACG", "ACG"]).union(rows(spark, "even", ["ACGT", "ACGT"])), "outside", broken)
    ref = rows(spark, "odd", ["ACG", "ACG"], "aligned").union(rows(spark, "even", ["ACGT", "ACGT"], "aligned"))
    scored = {r.family: r for r in evaluation.scored(made, ref).collect()}
    assert scored["odd"].error == "RuntimeError: no such tool" and scored["odd"].sp == 0 and scored["even"].sp == 100
    categories = seqs.select("family").distinct().withColumn("dataset", F.lit("d"))
    assert evaluation.sweep(seqs, true, ["fast"], categories).count() == 2
    told = evaluation.calibration_cases(seqs, true)
    assert told.filter("predicted < 0 OR predicted > 1").count() == 0 and evaluation.calibration_report(told).first().brier <= 1
    assert evaluation.accuracy(true.filter("family = 'g0'"), true).filter("recall IS NULL").count() == 3


def test_masks_and_intervals(spark):
    seqs = rows(spark, "f", K.generate_family(6, 30, 2))
    made = A.align_runs(seqs, 3)
    got = evaluation.masked(made.filter("run_id = 0"), made, 3, 0.5).collect()
    assert len(got) == 6 and len({(len(r.aligned), r.n_kept) for r in got}) == 1
    results = spark.createDataFrame([("a", float(i)) for i in range(6)] + [("b", 1.0)], "method string, score double")
    ci = {r.method: r for r in calibration.spread_ci(results, 500).collect()}
    assert ci["a"].low < 2.5 < ci["a"].high and ci["b"].low is None


def test_hits_and_search_sets(spark):
    fams = spark.createDataFrame([("x", "a", "A-C"), ("x", "b", "AC."), ("y", "a", "GG")], "family string, name string, aligned string")
    found = spark.createDataFrame([("x", "x__a"), ("x", "y__a"), ("y", "y__a")], "family string, name string")
    got = {r.family: (r.tp, r.fp, r.fn) for r in evaluation.hits_of(fams, found).collect()}
    assert got == {"x": (1, 1, 1), "y": (1, 0, 0)}
    assert {r.seq for r in evaluation.search_set(fams).collect()} == {"AC", "GG"}


def test_command_line(spark, tmp_path):
    true = K.generate_alignment(5, 30, 1)
    (tmp_path / "cases" / "RV1").mkdir(parents=True)
    api.write(rows(spark, "f", true, "aligned"), f"{tmp_path}/msf", "msf")
    (msf,) = (tmp_path / "msf" / "family=f").glob("*.txt")
    (tmp_path / "cases" / "RV1" / "c1.msf").write_text(msf.read_text())
    (tmp_path / "cases" / "RV1" / "c1.tfa").write_text("".join(f">s{i}\n{r.replace('-', '')}\n" for i, r in enumerate(true)))
    api.main(["evaluate", "-i", f"{tmp_path}/cases", "-o", f"{tmp_path}/out", "--methods", "fast"])
    (score,) = spark.read.json(f"{tmp_path}/out/scores/json").collect()
    assert score.family == "c1" and score.dataset == "cases_RV1" and 0 < score.sp <= 100
    api.main(["align", "-i", f"{tmp_path}/cases/RV1/c1.tfa", "-o", f"{tmp_path}/aln", "--mode", "fast", "--ensemble", "2", "--min-support", "2", "--save-poar", f"{tmp_path}/poar", "-q"])
    api.main(["align", "-i", f"{tmp_path}/cases/RV1/c1.tfa", "-o", f"{tmp_path}/again", "--load-poar", f"{tmp_path}/poar", "--min-support", "2"])
    one, two = (sorted(r.value for r in spark.read.text(f"{tmp_path}/{x}").collect()) for x in ("aln", "again"))
    assert one == two and api.get_num_threads(spark) >= 1


def test_sweeps_with_and_without_pairs(spark, monkeypatch):
    seqs = rows(spark, "f", K.generate_family(7, 25, 3)).union(rows(spark, "g", K.generate_family(4, 20, 4)))
    made = A.align_runs(seqs, 4).cache()
    plain = {(r.family, r.min_support): r.pairs for r in pairs._sweep_of_pairs(made, 4).collect()}
    assert {(r.family, r.min_support): r.pairs for r in pairs.support_sweep(made, 4).collect()} == plain and len(plain) == 8
    made.unpersist()


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(columns, "BLOCK_ROWS", 3)
    wide = rows(spark, "f", K.generate_alignment(11, 20, 6), "aligned")
    got = columns.row_pairs(wide).collect()
    texts = {r.rank: r.aligned for r in wide.collect()}
    assert sorted((r.i, r.j) for r in got) == list(itertools.combinations(range(11), 2))
    assert all((r.x, r.y) == (texts[r.i], texts[r.j]) for r in got)
