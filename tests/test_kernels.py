"""Alignment kernels by their invariants and against plain recurrences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import align as K
from seqloom.functions import trees
from seqloom.functions.kernels import infix_distance
from seqloom.functions.rng import Random
from seqloom.functions.scoring import kind_of, scores_for

FAMILIES = [
    ["ATCGATCG", "ATCGTCG", "ATCGATCG"],
    ["GATTACA", "GATTA"],
    ["MKTAYIAK", "MKTAYK", "MKTAYIAK"],
    ["AUCGAUCG", "AUCGUCG", "AUCGAUCG"],
    ["A", "ACGTACGTACGTA"],
    K.generate_family(12, 45, 3),
    K.generate_family(9, 60, 4, dna=True),
]


@pytest.mark.parametrize("seqs", FAMILIES)
@pytest.mark.parametrize("o", [*K.MODES.values(), K.Options(refine="all"), K.Options(refine="confident"), K.Options(ensemble=3, min_support=2)])
def test_rows_are_the_sequences_with_gaps(seqs, o):
    rows = K.align_family([f"s{i}" for i in range(len(seqs))], seqs, o)
    assert len({len(r) for r in rows}) == 1
    assert [r.replace("-", "") for r in rows] == seqs
    assert all(any(r[c] != "-" for r in rows) for c in range(len(rows[0])))


def test_input_order_does_not_matter():
    seqs = K.generate_family(10, 40, 8)
    names = [f"n{i}" for i in range(10)]
    want = dict(zip(names, K.align_family(names, seqs), strict=True))
    order = random.Random(1).sample(range(10), 10)
    got = K.align_family([names[i] for i in order], [seqs[i] for i in order])
    assert got == [want[names[i]] for i in order]


def test_equal_sequences_need_no_gap():
    assert K.align_family(list("abc"), ["MKTAYIAKQR"] * 3) == ["MKTAYIAKQR"] * 3
    assert K.align_family(["a", "b", "c"], ["MKTAYIAK", "MKTAYK", "MKTAYIAK"])[1].startswith("MKTAY")


def plain_affine(score, s):
    """The same recurrence a cell at a time."""
    n, m = score.shape
    low = -1e30
    a, x, y = (np.full((n + 1, m + 1), low) for _ in range(3))
    a[0, 0] = 0
    for j in range(1, m + 1):
        x[0, j] = -s.gap_terminal * j
    for i in range(1, n + 1):
        y[i, 0] = -s.gap_terminal * i
        for j in range(1, m + 1):
            px = x[i - 1, j - 1] - (0 if i == 1 else s.gap_open)
            py = y[i - 1, j - 1] - (0 if j == 1 else s.gap_open)
            a[i, j] = max(a[i - 1, j - 1], px, py) + score[i - 1, j - 1]
            o, e = (s.gap_terminal, s.gap_terminal) if j == m else (s.gap_open, s.gap_extend)
            y[i, j] = max(a[i - 1, j] - o, y[i - 1, j] - e)
            o, e = (s.gap_terminal, s.gap_terminal) if i == n else (s.gap_open, s.gap_extend)
            x[i, j] = max(a[i, j - 1] - o, x[i, j - 1] - e)
    return max(a[n, m], x[n, m], y[n, m])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 10**6))
def test_pairwise_matches_the_plain_recurrence(n, m, seed):
    s = scores_for("protein")
    score = np.random.default_rng(seed).integers(-4, 8, (n, m)).astype(np.float32)
    path, total = K.pairwise(score, s)
    assert total == pytest.approx(plain_affine(score, s), abs=1e-3)
    assert [p for p, _ in path if p >= 0] == list(range(n)) and [q for _, q in path if q >= 0] == list(range(m))


def test_distances():
    assert infix_distance("xxGATTACAxx", "GATTACA") == 0
    assert trees.pair_distance("GATTACA", "GATTA") == pytest.approx(0.0006)
    assert trees.identity_distances(["AC-T", "ACGT", "----"]).tolist()[0] == [0, 0, 1.0]


@pytest.mark.parametrize("n", [2, 17, 60, 130])
def test_tree_joins_everything_once(n):
    seqs = sorted(K.generate_family(n, 30, n), key=lambda s: (-len(s), s))
    tree = trees.guide_tree(seqs)
    assert len(tree) == n - 1 and [c for *_, c in tree] == list(range(n, 2 * n - 1))
    used = [x for a, b, _ in tree for x in (a, b)]
    assert sorted(used) == list(range(2 * n - 2))
    assert all(max(a, b) < c for a, b, c in tree)
    assert trees.guide_tree(seqs, 5, 0.3) == trees.guide_tree(seqs, 5, 0.3)


def test_refinement_never_lowers_the_score():
    seqs = K.generate_family(10, 50, 21)
    names = [str(i) for i in range(10)]
    s = scores_for("protein")
    plain, better = (K.sum_of_pairs(K.align_family(names, seqs, o), s) for o in (K.Options(), K.Options(refine="all")))
    assert better >= plain - 1e-6


def test_consensus_of_one_alignment_keeps_its_pairs():
    rows = ["AC-GT", "ACCGT", "A--GT"]
    seqs = [r.replace("-", "") for r in rows]
    support = K.support_table([rows, rows])
    got = K.consensus(seqs, support, 2)
    assert set(K.support_table([got])) == set(support)


def test_random_numbers():
    r = Random(42)
    x = [r.uniform() for _ in range(4000)]
    assert abs(np.mean(x) - 0.5) < 0.02 and Random(42).bits() == Random(42).bits()
    z = [r.normal(1, 2) for _ in range(4000)]
    assert abs(np.mean(z) - 1) < 0.15 and abs(np.std(z) - 2) < 0.15


def test_kinds():
    assert kind_of(["ACGTACGTNN"]) == "dna" and kind_of(["MKTAYIAKQRQISFVK"]) == "protein"
    with pytest.raises(ValueError):
        scores_for("plastic")
