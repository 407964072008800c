"""Repeated bytes, fingerprints and near duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import common, hamming, repeats, simhash


def brute_repeats(texts, window):
    count = Counter(t[i : i + window] for t in texts.values() for i in range(len(t) - window + 1))
    out = {}
    for k, t in texts.items():
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out[k] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    shared = ["".join(r.choice("abcd ") for _ in range(60)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = "".join(r.choice("abcdefgh ") for _ in range(r.randrange(80)))
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            a = r.randrange(20)
            t += p[a : a + r.randrange(20, 60)] + "".join(r.choice("xyzé") for _ in range(r.randrange(30)))
        texts.append(t)
    texts += [texts[3], texts[3], "ab" * 100, "z" * 150, None, ""]
    return texts


@pytest.mark.parametrize("limit", [1024, 2])
def test_repeats_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "PIECES", limit)  # 2: oversized keys are cut, level by level
    monkeypatch.setattr(repeats, "SEGMENT", 90)  # long texts are cut with an overlap
    texts = corpus(limit)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.remove_repeats(docs, window=24, anchor=8).collect()}
    want = brute_repeats({i: (t or "").encode() for i, t in enumerate(texts)}, 24)
    assert got == want
    assert sum(w[1] for w in want.values()) > 500


def brute_passages(texts, words):
    """n_passages, passage_bytes of each text."""
    import re

    spans = {k: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for k, t in texts.items()}
    seq = {k: [texts[k][a:b] for a, b in s] for k, s in spans.items()}
    holds = {}
    for k, s in seq.items():
        for i in range(len(s) - words + 1):
            holds.setdefault(tuple(s[i : i + words]), set()).add(k)
    out = {}
    for k, s in seq.items():
        runs = []
        for i in range(len(s) - words + 1):
            if len(holds[tuple(s[i : i + words])]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + words - 1
                else:
                    runs.append([i, i + words - 1])
        out[k] = (len(runs), sum(spans[k][b][1] - spans[k][a][0] for a, b in runs))
    return out


@pytest.mark.parametrize("segment", [90, 1 << 19])
def test_passages_match_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    r = random.Random(segment)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(1, 5))) for _ in range(40)]
    shared = [[r.choice(words) for _ in range(30)] for _ in range(5)]
    texts = []
    for _ in range(60):
        t = [r.choice(words) for _ in range(r.randrange(20))]
        for _ in range(r.randrange(3)):
            p, a = r.choice(shared), r.randrange(18)
            t += p[a : a + r.randrange(6, 30)] + [r.choice(words) for _ in range(r.randrange(9))]
        texts.append(r.choice([" ", "\n", "\x0b "]).join(t))
    texts += [texts[3], " " + texts[3] + "\t", "ab " * 90, "once only " * 40, None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_passages, x.passage_bytes) for x in repeats.remove_repeats(docs, window=400, anchor=128, words=8).collect()}
    assert got == brute_passages({i: (t or "").encode() for i, t in enumerate(texts)}, 8)
    assert sum(n for n, _ in got.values()) > 40


def test_repeats_odd_rows(odd, empty):
    rows = [tuple(r) for r in repeats.remove_repeats(odd).collect()]
    assert len(rows) == 7
    by_size = {r[1]: r for r in rows}
    assert by_size[150000][2] == 150000 and by_size[150000][3] == 1  # repeats itself
    assert by_size[0][4] == hashlib.sha256(b"").hexdigest()
    assert repeats.remove_repeats(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=30), min_size=1, max_size=8), st.integers(2, 6))
def test_rounds_find_equal_aligned_windows(texts, window):
    strings = [t.encode() for t in texts if len(t) >= window]
    if not strings:
        return
    leads = np.array([len(s) % 5 for s in strings])
    got = repeats.repeated_ends(strings, leads, window)
    for i, s in enumerate(strings):
        want = [
            a
            for a in range(len(s) - window + 1)
            if any(j != i and (b := a - leads[i] + leads[j]) >= 0 and b + window <= len(x) and x[b : b + window] == s[a : a + window] for j, x in enumerate(strings))
        ]
        assert got[i].tolist() == want


def plain_fingerprint(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aBé \n\x0b\x1c\xa0.", max_size=60), st.integers(1, 5))
def test_shingle_fingerprint(text, k):
    assert simhash.shingle_fingerprint(text, k) == plain_fingerprint(text, k)


def brute_components(values, radius):
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize(("radius", "cell"), [(4, 2048), (4, 8), (7, 16), (4, 30)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, radius, cell):
    monkeypatch.setattr(hamming, "CELL_ROWS", cell)  # small: cells are dealt out by pairs of blocks
    r = random.Random(radius + cell)
    centres = [r.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for c in centres for _ in range(60)} | {0, 1, 2**64 - 1})
    fps = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "w0 long")
    segments = 2 if cell == 30 else None  # as for very many fingerprints: balls of two bits
    got = {row.node % 2**64: row.root % 2**64 for row in hamming.components(hamming.links(fps, radius, segments)).collect()}
    want = brute_components(values, radius)
    groups = {}
    for v, w in zip(values, want, strict=True):
        groups.setdefault(w, []).append(v)
    for members in groups.values():
        assert len({got.get(v, v) for v in members}) == 1
    assert len({got.get(v, v) for v in values}) == len(groups)


@pytest.mark.parametrize("cell", [2048, 8])
def test_neighbour_counts(spark, monkeypatch, cell):
    monkeypatch.setattr(hamming, "CELL_ROWS", cell)
    r = random.Random(cell)
    base = [r.getrandbits(128) for _ in range(4)]
    values = sorted({b ^ sum(1 << x for x in r.sample(range(128), r.randrange(4))) for b in base for _ in range(40)})
    signed = lambda x: x - 2**64 if x >> 63 else x
    fps = spark.createDataFrame([(signed(v >> 64), signed(v % 2**64)) for v in values], "w0 long, w1 long")
    got = {((x.w0 % 2**64) << 64) + x.w1 % 2**64: x.n for x in hamming.neighbour_counts(fps, 3, 2).collect()}
    for v in values:
        assert got.get(v, 0) == sum(0 < (v ^ w).bit_count() <= 3 for w in values)


def test_near_duplicates_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 7
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1, 2} and {r.component_id for r in rows if r.doc_id in zero} == {1}
    assert simhash.near_duplicates(empty).collect() == []


def test_document_fingerprints(spark, empty):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 200))) for _ in range(40)] + [None, "", "abc"]
    ids = r.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in simhash.document_fingerprints(docs).collect()}
    order = sorted(zip(ids, texts, strict=True))
    h = simhash.Terms()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + n[:k]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, e = h.fingerprint(t), h.fingerprint(edited)
        assert (x.fingerprint, x.edited_fingerprint) == (a.hex(), e.hex())
        assert x.near_edited == simhash.likeness(a, e) and x.near_next == simhash.likeness(a, h.fingerprint(n))
    long = [x for x in got.values() if x.n_chars > 300]
    assert np.mean([x.near_edited for x in long]) > 0.6 > 0.3 > np.mean([x.near_next for x in long])
    assert simhash.document_fingerprints(empty).collect() == []


def test_document_fingerprints_of_one_id(spark, monkeypatch):
    """Rows of one id, or of none, fill several ranges; every row is followed by the next, the last by the first."""
    monkeypatch.setattr(common, "RANGE_BYTES", 300)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(8))) for i in range(40)] + [(20, f"{word()} {i} {word()} same id") for i in range(60)] + [(None, f"{word()} {i} no id") for i in range(30)]
    rows.append(rows[45])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.edited_prints(docs).collect()
    assert len(got) == len(rows)
    edited = lambda t, n: t[: len(t) - len(t) // 4] + n[: len(t) // 4]
    have = Counter((x.doc_id, x.edited_sha256) for x in got)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    # between ids the successor is known; within one id each row is a successor once
    order = sorted(texts, key=lambda i: -1 if i is None else i)
    for i, n in zip(order, order[1:] + order[:1], strict=True):
        nexts = texts[i] + texts[n]
        possible = {hashlib.sha256(edited(t, x).encode()).hexdigest() for t in texts[i] for x in nexts}
        mine = [h for (k, h), c in have.items() if k == i for _ in range(c)]
        assert len(mine) == len(texts[i]) and set(mine) <= possible


def test_document_fingerprints_odd_rows(odd):
    rows = simhash.document_fingerprints(odd).collect()
    assert len(rows) == 7 and len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1


def test_one_of_each(spark, odd):
    kept = simhash.one_of_each(odd, 5, 7)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5]


def test_one_of_each_judges_texts_not_ids(spark):
    """Rows of one id, or of none, with other texts are judged apart; no text that resembles none is lost."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(500)]
    a, b, c, d = (" ".join(r.choice(words) for _ in range(200)) for _ in range(4))
    near = " ".join(["changed", *a.split()[1:]])
    rows = [(1, a), (5, near), (5, b), (9, a), (None, c), (None, d), (None, near), (7, d), (7, d)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, H0 string, id string")
    kept = simhash.one_of_each(docs, 5, 5)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == sorted([(1, a), (5, b), (0, c), (7, d)])


def test_one_of_each_keeps_what_resembles_none(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(2000)]
    docs, groups = [], {}
    for g in range(60):
        base = [r.choice(words) for _ in range(r.randrange(60, 200))]
        for c in range(r.choice([1, 1, 2, 5, 14])):
            text = list(base)
            for _ in range(c and r.randrange(0, max(1, len(base) // 60) + 1)):
                text[r.randrange(len(text))] = "changed"
            groups[len(docs)] = g
            docs.append((len(docs), " ".join(text)))
    order = r.sample(docs, len(docs))
    kept = [x.doc_id for x in simhash.one_of_each(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 5, 7).collect()]
    sets = {i: set(simhash.shingles(t, 5)) for i, t in docs}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(like(a, b) < 0.8 for a in kept for b in kept if a < b)
    assert all(i in kept or any(like(i, x) >= 0.8 for x in kept) for i, _ in docs)
    assert {groups[i] for i in kept} == set(groups.values())


def _edited(r, words, base, kind, share):
    n = max(1, int(len(base) * share))
    if kind == "appended":
        return base + [r.choice(words) for _ in range(n)]
    if kind == "cut off":
        return base[: len(base) - n]
    text = list(base)
    for i in r.sample(range(len(base)), n):
        text[i] = "changed"
    return text


@pytest.mark.parametrize("kind,share", [("appended", 0.1), ("appended", 0.19), ("cut off", 0.1), ("cut off", 0.18), ("replaced", 0.01), ("replaced", 0.02)])
def test_one_of_each_finds_edited_copies(spark, kind, share):
    r = random.Random(f"{kind}{share}")
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    docs, asked = [], []
    for _ in range(150):
        base = [r.choice(words) for _ in range(r.randrange(60, 400))]
        both = [" ".join(base), " ".join(_edited(r, words, base, kind, share))]
        a, b = (set(simhash.shingles(t, 5)) for t in both)
        if len(a & b) >= 0.8 * len(a | b):
            asked.append(len(docs) + 1)
        docs += [(len(docs), both[0]), (len(docs) + 1, both[1])]
    kept = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), 5, 5).collect()}
    assert len(asked) > 100 and not kept.intersection(asked)
    assert len(kept) == len(docs) - len(asked)


@pytest.mark.parametrize("original", ["first", "last"])
def test_one_of_each_star(spark, original):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    base = [r.choice(words) for _ in range(343)]
    texts = [" ".join(base)] + [" ".join(_edited(r, words, base, "replaced", 0.02)) for _ in range(60)]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(sets[0], s) >= 0.8 for s in sets)
    assert np.mean([like(a, b) >= 0.8 for i, a in enumerate(sets[1:], 1) for b in sets[1:i]]) < 0.1
    texts = texts if original == "first" else texts[::-1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [x.doc_id for x in simhash.one_of_each(docs, 5, 5).collect()] == [0]


def test_one_of_each_keeps_the_smallest_of_each_component(spark, monkeypatch):
    """Chains whose ends do not resemble each other, against brute force; cells dealt out by blocks."""
    monkeypatch.setattr("seqloom.llm.hamming.CELL_ROWS", 4)
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    texts = []
    for _ in range(25):
        now = [r.choice(words) for _ in range(200)]
        for _ in range(r.randrange(1, 9)):
            texts.append(" ".join(now))
            now = _edited(r, words, now, r.choice(["replaced", "appended"]), 0.015)
            now[r.randrange(len(now))] = r.choice(words)
    r.shuffle(texts)
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    forest = hamming.Forest()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                forest.join(i, j)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in simhash.one_of_each(docs, 5, 5).collect()) == [i for i in range(len(texts)) if forest.root(i) == i]


@pytest.mark.parametrize("cell", [2048, 4])
def test_one_of_each_links_by_simhash(spark, monkeypatch, cell):
    """With bands of so many least hashes that they find next to nothing, fingerprints give the candidates: against brute force."""
    monkeypatch.setattr("seqloom.llm.hamming.CELL_ROWS", cell)
    monkeypatch.setattr(simhash, "MISS", 0.9999999)
    rows = 60
    assert simhash.bands_for(0.8, rows) == 1
    r = random.Random(10)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    texts = ["", None, " \n"]
    for g in range(25):
        base = [r.choice(words) for _ in range(200)]
        texts += [" ".join(base), *(" ".join(_edited(r, words, base, "replaced", 0.005 * (1 + c % 3))) for c in range(8))]
        # fingerprints agree where one line is most of a text, and texts that share no more than it are no duplicates
        texts += [" ".join([f"line{g}"] * 3000 + [r.choice(words) for _ in range(200)]) for _ in range(3)]
    r.shuffle(texts)
    whole = [t or "" for t in texts]
    sets = [set(simhash.shingles(t, 5)) for t in whole]
    prints = [simhash.shingle_fingerprint(t) for t in whole]
    bands = [simhash.band_keys(simhash.least_hashes(simhash.gram_hashes(t, 5), rows), rows).tolist() for t in whole]
    near, both, banded = hamming.Forest(), hamming.Forest(), hamming.Forest()
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    for i, j in pairs:
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            near.join(i, j)
    unlike = 0
    for i, j in pairs:
        alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        unlike += near.root(i) == near.root(j) and not alike
        if alike and bands[i] == bands[j]:
            banded.join(i, j)
        if alike and (near.root(i) == near.root(j) or bands[i] == bands[j]):
            both.join(i, j)
    want = [i for i in range(len(texts)) if both.root(i) == i]
    assert unlike > 50 and len(want) < 0.8 * sum(banded.root(i) == i for i in range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in simhash.one_of_each(docs, 5, rows).collect()) == want
