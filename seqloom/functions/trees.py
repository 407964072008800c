"""Guide trees: distances to anchors, average linkage, bisecting k-means.  A tree is a list of merges (a, b, c)."""

from __future__ import annotations

import numpy as np

from seqloom.functions.kernels import infix_distance_many
from seqloom.functions.rng import Random

PATTERN, EXACT, ANCHORS, SEEDS = 1024, 50, 32, 40


def pair_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The shorter (the later of equals) may match anywhere in the longer; plus a small term for length."""
    ordered = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    far = infix_distance_many([t for t, _ in ordered], [p[:PATTERN] for _, p in ordered])
    return far + np.minimum(10000, np.array([(len(a) + len(b)) // 2 for a, b in pairs], np.int64)) / 10000


def pair_distance(a: str, b: str) -> float:
    return float(pair_distances([(a, b)])[0])


def all_distances_many(families: list[list[str]]) -> list[np.ndarray]:
    """Distances of all pairs of each family."""
    out, at = [], 0
    far = pair_distances([(f[i], f[j]) for f in families for i in range(len(f)) for j in range(i + 1, len(f))])
    for f in families:
        n = len(f)
        d = np.zeros((n, n))
        upper = np.triu_indices(n, 1)
        d[upper] = far[at : at + len(upper[0])]
        at += len(upper[0])
        out.append(d + d.T)
    return out


def all_distances(seqs: list[str]) -> np.ndarray:
    return all_distances_many([seqs])[0]


def identity_distances(rows: list[str]) -> np.ndarray:
    """1 - identity over columns where both rows have a residue; 1 without any."""
    grid = np.array([np.frombuffer(r.encode(), np.uint8) for r in rows])
    seen = grid != ord("-")
    n = len(rows)
    out = np.zeros((n, n))
    for i in range(n):
        both = seen & seen[i]
        met = both.sum(1)
        same = (both & (grid == grid[i])).sum(1)
        out[i] = np.where(met > 0, 1 - same / np.maximum(met, 1), 1.0)
    np.fill_diagonal(out, 0)
    return out


def anchor_places(n: int, most: int = ANCHORS) -> list[int]:
    k = min(most, n)
    stride = n // k
    return [i * stride for i in range(k)]


def spread_anchors(seqs: list[str], embedding: np.ndarray | None, count: int) -> list[int]:
    """Up to `count` sequences far from one another: the first is the nearest to the mean of the sequences' mean distances
    to length, each next the one whose value is farthest from those chosen; of equals the first."""
    if len(seqs) < 3:
        return []
    far = embed(seqs) if embedding is None else embedding
    x = far.mean(1) / np.maximum(1, np.array([len(s) for s in seqs]))
    chosen = [int(np.argmin(np.abs(x - x.mean())))]
    gap = np.abs(x - x[chosen[0]])
    while len(chosen) < min(count, len(seqs)):
        gap[chosen] = -1
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, np.abs(x - x[chosen[-1]]))
    return chosen


def embed(seqs: list[str]) -> np.ndarray:
    """A row for each sequence: distances to every n / K-th in the given (canonical) order."""
    return embed_many([seqs])[0]


def embed_many(families: list[list[str]]) -> list[np.ndarray]:
    anchors = [[f[i] for i in anchor_places(len(f))] for f in families]
    far, out, at = pair_distances([(s, a) for f, own in zip(families, anchors, strict=True) for s in f for a in own]), [], 0
    for f, own in zip(families, anchors, strict=True):
        size = len(f) * len(own)
        out.append(far[at : at + size].reshape(len(f), len(own)))
        at += size
    return out


def linkage(distance: np.ndarray, nodes: list[int], first: int) -> list[tuple[int, int, int]]:
    """Weighted average linkage: the first least pair merges; its distance to others is the mean of the two plus 0.001."""
    d = distance.astype(float).copy()
    live, merges = list(nodes), []
    np.fill_diagonal(d, np.inf)
    while len(live) > 1:
        i, j = divmod(int(np.argmin(d)), len(live))
        i, j = min(i, j), max(i, j)
        merges.append((live[i], live[j], first))
        new = (d[i] + d[j]) / 2 + 0.001
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        live[i] = first
        del live[j]
        first += 1
    return merges


def _split(x: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Two clusters from a seed point and its reflection through the mean; (side of each row, score)."""
    mean = x.mean(0)
    left, right = x[seed].copy(), 2 * mean - x[seed]
    side = np.zeros(len(x), bool)
    for _ in range(500):
        a, b = np.linalg.norm(x - left, axis=1), np.linalg.norm(x - right, axis=1)
        tie = np.abs(a - b) < 1e-6
        now = np.where(tie, np.arange(len(x)) % 2 == 1, b < a)
        if now.all() or not now.any():
            now = np.arange(len(x)) >= len(x) // 2
            return now, float(np.minimum(a, b).sum())
        if (now == side).all() and side.any():
            break
        side = now
        left, right = x[~side].mean(0), x[side].mean(0)
    return side, float(np.linalg.norm(x[~side] - left, axis=1).sum() + np.linalg.norm(x[side] - right, axis=1).sum())


def bisect(seqs: list[str], points: np.ndarray) -> list[tuple[int, int, int]]:
    """Top-down splits; clusters under EXACT sequences by linkage of their own distances."""
    merges: list[tuple[int, int, int]] = []
    count = len(seqs)

    def leaf(nodes: np.ndarray) -> int:
        if len(nodes) == 1:
            return int(nodes[0])
        got = linkage(all_distances([seqs[i] for i in nodes]), nodes.tolist(), count + len(merges))
        merges.extend(got)
        return got[-1][2]

    # post-order without recursion
    work: list[tuple[np.ndarray | None, int]] = [(np.arange(count), 0)]
    done: list[int] = []
    while work:
        nodes, joined = work.pop()
        if joined:
            b, a = done.pop(), done.pop()
            merges.append((a, b, count + len(merges)))
            done.append(merges[-1][2])
        elif len(nodes) < EXACT:
            done.append(leaf(nodes))
        else:
            best, step = None, max(1, len(nodes) // SEEDS)
            for start in range(0, len(nodes), 4 * step):
                tried = [_split(points[nodes], s) for s in range(start, min(start + 4 * step, len(nodes)), step)]
                top = min(tried, key=lambda t: t[1])
                if best is not None and top[1] >= best[1]:
                    break
                best = top
            side = best[0]
            work += [(None, 1), (nodes[side], 0), (nodes[~side], 0)]
    return merges


def guide_tree(seqs: list[str], seed: int = 0, noise: float = 0.0) -> list[tuple[int, int, int]]:
    """Merges for sequences in canonical order; noise multiplies distances by N(1, noise), no less than 0.1."""
    return guide_trees([seqs], [seed], noise)[0]


def guide_trees(families: list[list[str]], seeds: list[int], noise: float = 0.0) -> list[list[tuple[int, int, int]]]:
    """guide_tree of each family; the distances of the small ones are computed together."""
    small = [k for k, f in enumerate(families) if 2 <= len(f) < EXACT]
    found = dict(zip(small, all_distances_many([families[k] for k in small]), strict=True))
    out = []
    for k, seqs in enumerate(families):
        rng = Random(seeds[k])
        shake = lambda d, rng=rng: d if not noise else d * np.array([max(0.1, rng.normal(1, noise)) for _ in range(d.size)]).reshape(d.shape)
        if len(seqs) < 2:
            out.append([])
        elif len(seqs) < EXACT:
            d = shake(found[k])
            out.append(linkage((d + d.T) / 2, list(range(len(seqs))), len(seqs)))
        else:
            out.append(bisect(seqs, shake(embed(seqs))))
    return out


def leaf_weights(tree: list[tuple[int, int, int]]) -> list[float]:
    """The weight of each leaf: their number at the root, shared on the way down in proportion to the sibling's size."""
    total = len(tree) + 1
    size, down = dict.fromkeys(range(total), 1), {tree[-1][2]: 0.0} if tree else {0: 0.0}
    for a, b, c in tree:
        size[c] = size[a] + size[b]
    for a, b, c in reversed(tree):
        for node, other in ((a, b), (b, a)):
            down[node] = down[c] + np.log(size[other] / size[c])
    return [float(np.exp(down[i]) * total) for i in range(total)]
