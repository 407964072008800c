"""Sequential kernels that no column expression can hold: one pair of strings in big integers, many pairs in NumPy."""

from __future__ import annotations

import numpy as np

#: Cells of the letter masks of the pairs that go through NumPy together (8 bytes each).
MASK_CELLS = 1 << 22


def infix_distances(text: str, pattern: str) -> list[int]:
    """For each end position in text, the least edit distance between pattern and a substring that ends there.

    Bit-parallel over the pattern in one big integer, so its length has no block limit.
    """
    m = len(pattern)
    if not m:
        return [0] * len(text)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere: the row above starts at 0
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def infix_distance(text: str, pattern: str) -> int:
    """The least edit distance between pattern and any substring of text (the empty one too)."""
    return min([len(pattern), *infix_distances(text, pattern)])


def infix_distance_many(texts: list[str], patterns: list[str]) -> np.ndarray:
    """infix_distance of each text and its pattern.

    The same recurrence over 64-bit words, a step for each place of all texts at once; the step in a word's first bit
    comes from the word below.  Pairs go longest text first, so that those still running are the first rows.
    """
    out = np.zeros(len(texts), np.int64)
    symbols = np.unique(_symbols("".join(patterns)))
    words = np.array([-(-len(p) // 64) for p in patterns], np.int64)
    for w in np.unique(words).tolist():
        of = np.flatnonzero(words == w)
        if not w:
            continue
        of = of[np.argsort([-len(texts[k]) for k in of], kind="stable")]
        step = max(1, MASK_CELLS // (w * (len(symbols) + 1)))
        for at in range(0, len(of), step):
            some = of[at : at + step]
            out[some] = _infix_words([texts[k] for k in some], [patterns[k] for k in some], symbols, w)
    return out


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _grid(strings: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places x strings: each letter's number among the sorted symbols, or how many they are; and the strings' lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    raw = _symbols("".join(strings))
    at = np.searchsorted(symbols, raw)
    at[(at == len(symbols)) | (symbols[np.minimum(at, len(symbols) - 1)] != raw)] = len(symbols)
    out = np.full((int(lengths.max(initial=0)), len(strings)), len(symbols), np.int64)
    out.T[np.arange(len(out)) < lengths[:, None]] = at
    return out, lengths


def _infix_words(texts: list[str], patterns: list[str], symbols: np.ndarray, w: int) -> np.ndarray:
    n, none = len(texts), len(symbols)
    one, row = np.uint64(1), np.arange(n)
    masks = np.zeros((n, none + 1, w), np.uint64)
    places, m = _grid(patterns, symbols)
    for j, of in enumerate(places):
        masks[row, of, j >> 6] |= one << np.uint64(j & 63)
    masks[:, none] = 0  # a letter that no pattern has
    letters, lengths = _grid(texts, symbols)
    last = one << ((m - 1) & 63).astype(np.uint64)
    up, down = np.full((w, n), ~np.uint64(0)), np.zeros((w, n), np.uint64)
    score, best, top = m.copy(), m.copy(), np.uint64(63)
    for j in range(len(letters)):
        k = int(np.searchsorted(-lengths, -j, side="left"))  # texts longer than j
        held = masks[row[:k], letters[j, :k]]
        plus = minus = np.zeros(k, np.uint64)  # a match may begin anywhere: the row above changes by nothing
        for x in range(w):
            eq, pv, mv = held[:, x], up[x, :k], down[x, :k]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if x == w - 1:
                score[:k] += ((ph & last[:k]) != 0).astype(np.int64) - ((mh & last[:k]) != 0)
            rise, fall = ph >> top, mh >> top
            ph, mh = (ph << one) | plus, (mh << one) | minus
            up[x, :k], down[x, :k] = mh | ~(xv | ph), ph & xv
            plus, minus = rise, fall
        np.minimum(best[:k], score[:k], out=best[:k])
    return best
