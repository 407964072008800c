"""Operators over whole families: results against plain counts, and rows of text alone in their shuffles."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seqloom.functions import cells
from seqloom.functions import encode as E
from seqloom.operators import columns, compare, pairs

RUNS = {
    0: ["AC-GT", "A-CGT", "ACG-T", "--ACG"],
    1: ["ACG-T", "ACG-T", "ACGT-", "A--CG"],
    2: ["ACGT-", "ACGT-", "ACGT-", "-ACG-"],
}
KEYS = ("family", "rank")


@pytest.fixture(scope="module")
def wide(spark):
    """Two families of the same rows, one of them thrice over, and one of a single row."""
    rows = [("f", k, i, f"s{i}", t) for k, texts in RUNS.items() for i, t in enumerate(texts)]
    rows += [("g", k, i, f"s{i}", texts[i % 4]) for k, texts in RUNS.items() for i in range(12)]
    rows += [("h", k, 0, "s0", "AC--") for k in RUNS]
    return spark.createDataFrame(rows, "family string, run_id int, rank int, name string, aligned string").repartition(3)


def cells_of(wide):
    out = {}
    for r in wide.collect():
        pos = 0
        for col, ch in enumerate(r.aligned):
            if ch != "-":
                out[r.family, r.run_id, r["rank"], pos] = col
                pos += 1
    return out


def plain_support(wide):
    """(family, i, j, p, q) -> runs, from all pairs of residues."""
    at, out = cells_of(wide), {}
    by = {}
    for (f, k, i, p), c in at.items():
        by.setdefault((f, k, c), []).append((i, p))
    for (f, k, _), here in by.items():
        for (i, p), (j, q) in combinations(sorted(here), 2):
            out.setdefault((f, i, j, p, q), set()).add(k)
    return out


def rows_shuffled(df):
    """Rows are dealt out by whole text rows: no explode lies under an exchange."""
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    return len(at), any("Generate" in line for line in plan[at[0] :]) if at else False


def small(monkeypatch):
    """Every count by sorting, every family by itself."""
    monkeypatch.setattr(cells, "TABLE", 1)
    monkeypatch.setattr(cells, "LETTERS", 1)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 5)
    monkeypatch.setattr(cells, "COMPARED", 10)


def blocks(wide, *order):
    import pyarrow as pa

    t = pa.Table.from_pandas(wide.toPandas().sort_values(list(order or ("family", "rank", "run_id"))), preserve_index=False)
    return [b for size in (1, 7, 1000) for b in [list(cells.blocks(iter(t.to_batches(max_chunksize=size))))]]


def test_blocks_hold_whole_families(wide, monkeypatch):
    for many in blocks(wide):
        assert sorted(f for b in many for f in b.families.to_pylist()) == ["f", "g", "h"]
        assert sum(b.table.num_rows for b in many) == wide.count()
    monkeypatch.setattr(cells, "LETTERS", 1)
    assert [len(many) for many in blocks(wide)] == [3, 3, 3]


def test_residue_and_column_confidence(wide):
    at, held = cells_of(wide), plain_support(wide)
    want = {}
    for (f, k, i, p), c in at.items():
        if k == 2:
            own = [len(v) for (g, a, b, x, y), v in held.items() if g == f and 2 in v and (i, p) in ((a, x), (b, y))]
            want[f, i, c] = sum(own) / (3 * len(own)) if own else 0.0
    made = pairs.residue_confidence(wide, 2, 3)
    got = {(r.family, r["rank"], r.col): r.confidence for r in made.collect()}
    assert got == pytest.approx(want) and made.schema["rank"].dataType == wide.schema["rank"].dataType
    means = {(r.family, r.col): r.confidence for r in pairs.column_confidence(made).collect()}
    told = pairs.column_confidences(wide, 2, 3)
    assert {(r.family, r.col): r.confidence for r in pairs.of_columns(told).collect()} == pytest.approx(means)
    assert {r.family: r.threshold for r in columns.edge_medians(told).collect()} == pytest.approx({r.family: r.threshold for r in columns.edge_median(pairs.column_confidence(made)).collect()})
    chosen = wide.filter("run_id = 2")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pairs.pp_rows(wide, 2, 3)) == rows(pairs.pp_strings(chosen, made))
    assert rows(pairs.confidence_mask(chosen, told, 0.6)) == rows(pairs.confidence_mask(chosen, pairs.column_confidence(made), 0.6))


def test_confidence_shuffles_rows_of_text(wide):
    """A row of residues was shuffled for each residue and run before."""
    for made in (pairs.residue_confidence(wide, 2, 3), pairs.of_columns(pairs.column_confidences(wide, 2, 3)), pairs.pp_rows(wide, 2, 3), pairs.column_cases(wide, 2, 3, 0)):
        assert rows_shuffled(made) == (1, False)


def test_column_cases(wide):
    want = {(r.family, r.col): r.correct for r in compare.column_correctness(wide.filter("run_id = 2"), wide.filter("run_id = 0")).collect()}
    conf = {(r.family, r.col): r.confidence for r in pairs.of_columns(pairs.column_confidences(wide, 2, 3)).collect()}
    got = {(r.family, r.col): (r.predicted, r.actual) for r in pairs.column_cases(wide, 2, 3, 0).collect()}
    assert got == {k: (v, want[k]) for k, v in conf.items()} and len(got) > 8


def test_counts_of_support(wide):
    held = plain_support(wide)
    masks = {}
    for (f, *_), runs in held.items():
        key = f, sum(1 << k for k in runs)
        masks[key] = masks.get(key, 0) + 1
    made = pairs.support_counts(wide, 3)
    assert {(r.family, r.mask): r.pairs for r in made.collect()} == masks
    sweep = {(f, t): sum(len(v) >= t for (g, *_), v in held.items() if g == f) for f in "fgh" for t in (1, 2, 3)}
    assert {(r.family, r.min_support): r.pairs for r in pairs.support_sweep(wide, 3).collect()} == sweep
    scores = {(f, k): sum((len(v) - 1) / 2 for (g, *_), v in held.items() if g == f and k in v) for f in "fgh" for k in RUNS}
    assert {(r.family, r.run_id): r.score for r in pairs.run_scores(wide, 3).collect()} == pytest.approx(scores)
    for df in (made, pairs.support_sweep(wide, 3), pairs.run_scores(wide, 3)):
        assert rows_shuffled(df) == (1, False)


def test_counts_of_support_by_sorting(wide, monkeypatch):
    want = sorted(map(tuple, pairs.support_counts(wide, 3).collect()))
    small(monkeypatch)
    got = []
    for b in blocks(wide)[0]:
        r = cells.residues(b, 3)
        got += [(b.families[f].as_py(), tuple(x)) for f, x in enumerate(cells.shared(r, b.n, pairs._subsets(3)).tolist())]
    of = dict(got)
    single = {f: sum(n for g, m, n in want if g == f and m & 1) for f in "fgh"}
    assert {f: of[f][0] for f in "fgh"} == single
    assert {f: of[f][6] for f in "fgh"} == {f: sum(n for g, m, n in want if g == f and m == 7) for f in "fgh"}


def test_shifts(wide):
    plain = {(r.family, r.run_id, r.i, r.j): (r.n, r.s) for r in pairs.extract(wide).groupBy("family", "run_id", "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("pos_i") - F.col("pos_j")).alias("s")).collect()}
    made = pairs.shifts(wide)
    assert {(r.family, r.run_id, r.i, r.j): (r.n, r["shift"]) for r in made.collect()} == plain
    assert rows_shuffled(made) == (1, False)


def test_comparison_against_plain_pairs(wide):
    at, held = cells_of(wide), plain_support(wide)
    ref, test = wide.filter("run_id = 0"), wide.filter("run_id = 1")
    got = {r.family: r for r in compare.detailed(ref, test).collect()}
    for f in "fgh":
        own = [v for (g, *_), v in held.items() if g == f]
        assert (got[f].ref_pairs, got[f].test_pairs, got[f].common) == (sum(0 in v for v in own), sum(1 in v for v in own), sum(0 in v and 1 in v for v in own))
    for f, n in (("f", 4), ("g", 12)):
        same = every = 0
        for (g, k, i, p), c in at.items():
            if g != f or k != 0:
                continue
            for j in set(range(n)) - {i}:
                facing = lambda run, col: next((q for (h, m, x, q), y in at.items() if (h, m, x, y) == (f, run, j, col)), None)  # noqa: E731, B023
                same += facing(0, c) == facing(1, at[f, 1, i, p])
                every += 1
        assert {r.family: r.sp for r in compare.sum_of_pairs(ref, test).collect()}[f] == pytest.approx(100 * same / every)
    for df in (compare.detailed(ref, test), compare.sum_of_pairs(ref, test), compare.column_correctness(test, ref)):
        assert rows_shuffled(df) == (1, False)


def test_mask_and_bound_of_gaps(spark, wide):
    ref, test = wide.filter("run_id = 0"), wide.filter("run_id = 1")
    on = spark.createDataFrame([(f, c, int(c != 1)) for f, w in (("f", 5), ("g", 5), ("h", 4)) for c in range(w)], "family string, col long, mask int")
    masked = {r.family: r for r in compare.detailed(ref, test, mask=on).collect()}
    held = plain_support(wide)
    at = cells_of(wide)
    for f in "fg":
        own = [k for k, v in held.items() if k[0] == f and 0 in v and at[f, 0, k[1], k[3]] != 1]
        assert (masked[f].ref_pairs, masked[f].common) == (len(own), sum(1 in held[k] for k in own))
    gaps = {r.family: r for r in compare.detailed(ref, test, 0.3).collect()}
    scored = {0, 1, 2, 3, 4} - {c for c in range(5) if sum(t[c] == "-" for t in RUNS[0]) / 4 > 0.3}
    assert gaps["f"].ref_pairs == sum(0 in v and at["f", 0, k[1], k[3]] in scored for k, v in held.items() if k[0] == "f")


def test_by_name_deals_rows_out_once(wide):
    """Two windows and two joins dealt both sides out seven times before."""
    a, _ = compare.by_name(wide.filter("run_id = 0"), wide.filter("run_id = 1"))
    assert rows_shuffled(a) == (1, False)


def test_statistics_shuffle_rows_of_text(wide):
    one = wide.filter("run_id = 0").drop("run_id")
    for df in (columns.alignment_stats(one), columns.column_consensus(one), columns.pairwise_identity(one), columns.identity_distance_mean(one), columns.gap_shares(one)):
        assert rows_shuffled(df) == (1, False)


def test_identities_by_blocks(wide, monkeypatch):
    one = wide.filter("run_id = 0")
    want = {(r.family, r.i, r.j): r.identity for r in columns.pairwise_identity(one).collect()}
    small(monkeypatch)
    got = {(b.families[b.of[first]].as_py(), x, y): v for b in blocks(one)[0] for first, i, j, own in cells.identities(b) for x, y, v in zip(i.tolist(), j.tolist(), own.tolist(), strict=True)}
    assert got == want and len(got) == 6 + 66
    for (f, i, j), v in want.items():
        x, y = RUNS[0][i % 4], RUNS[0][j % 4]
        both = [(p, q) for p, q in zip(x, y, strict=True) if "-" not in (p, q)]
        assert v == pytest.approx(sum(p == q for p, q in both) / len(both) if both else 0.0), (f, i, j)


def test_type_of_no_letters(spark):
    """A text without letters has no letter of a protein; SQL's patterns agree."""
    rows = spark.createDataFrame([("",), ("--",), ("ACGN",), ("ACGU",), ("ACDE",), (None,)], "seq string")
    assert [r.kind for r in rows.select(E.infer_type(F.col("seq")).alias("kind")).collect()] == ["DNA", "DNA", "DNA", "RNA", "protein", "protein"]


def families_of(spark, many=24, n=7):
    from seqloom.operators import align

    return align.generate(spark, many, n, 20, 7, True)


def test_few_bytes_go_to_many_tasks(spark, wide):
    """Texts of few bytes were brought together in one task, however long they take to align."""
    from seqloom.operators import align

    n = 2 * spark.sparkContext.defaultParallelism
    seqs = families_of(spark).drop("run_id")
    for df in (align.align(seqs, "fast"), align.guide_trees(seqs), pairs.residue_confidence(wide, 2, 3)):
        assert df.rdd.getNumPartitions() >= n


def test_best_rows(spark):
    from seqloom.operators import align

    made = align.align_runs(families_of(spark), 3)
    best = pairs.best_run(pairs.run_scores(made, 3))
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(pairs.best_rows(made, 3)) == rows(made.join(best, ["family", "run_id"])) and len({r.run_id for r in best.collect()}) > 1


def test_consensus_of_runs(spark):
    """The same as from a table of pairs, at each threshold; an empty sequence is a row of gaps."""
    from seqloom.operators import align

    seqs = families_of(spark, 6)
    made = align.align_runs(seqs, 2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for least in (1, 2):
        assert rows(align.consensus_of_runs(seqs, made, 2, least)) == rows(align.consensus_from_support(seqs, pairs.support(made), least))
    with_empty = seqs.unionByName(spark.createDataFrame([("g0", 99, "e", "")], "family string, rank long, name string, seq string"))
    got = [r for r in align.consensus_of_runs(with_empty, align.align_runs(with_empty, 2), 2, 2).filter("family = 'g0'").collect()]
    assert len({len(r.aligned) for r in got}) == 1 and next(r for r in got if r["rank"] == 99).aligned.strip("-") == ""


def test_tree_weights(spark):
    from seqloom.operators import align, trees

    seqs = families_of(spark, 5, 60).unionByName(families_of(spark, 1, 1).withColumn("family", F.lit("one")))
    tree = align.guide_trees(seqs)
    n = seqs.groupBy("family").agg(F.count("*").alias("n"))
    leaves = n.select("family", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("leaf"))
    want = {(r.family, r.leaf): r.weight for r in trees.leaf_weights(tree, trees.members(tree, leaves)).collect()}
    assert {(r.family, r.leaf): r.weight for r in align.tree_weights(seqs).collect()} == pytest.approx(want) and len(want) == 300


def test_inline_trials_in_lockstep():
    """Families aligned together give what each gives alone."""
    from seqloom.functions import align as kernel

    families = [kernel.generate_family(n, 20, n, True) for n in (3, 5, 9, 14)]
    for adaptive in (False, True):
        o = kernel.Options(refine="inline", adaptive_budget=adaptive)
        of = [([f"s{i}" for i in range(len(f))], f) for f in families]
        assert kernel.align_families(of, o) == [kernel.align_family(*x, o) for x in of]
