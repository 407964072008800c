"""Progressive alignment of one family in NumPy: profiles, affine dynamic programming, refinement, consensus."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from seqloom.functions import trees
from seqloom.functions.scoring import PROTEIN, PROTEINS, Scores, code_table, matrix_file, scores_for, type_for

LOW = np.float32(-1e30)


#: Places of all pairs in a row of a sweep: what a processor's cache holds of the states.
ACROSS = 1 << 15
#: Cells whose way back is kept at once; a larger pair keeps some rows and goes through its blocks again.
CELLS = 1 << 24
MATCH, OVER, UNDER = 0, 1, 2  # a column of both, a gap in the first, a gap in the second


@dataclass
class Pair:
    """Two sides to be aligned: rows(i, j) gives the scores of places i to j of the first against all of the second."""

    n: int
    m: int
    rows: Callable[[int, int], np.ndarray]
    s: Scores


class _Sweep:
    """The recurrence a row at a time, over several pairs at once.

    Three states; gaps along a row are a running maximum.  Entering and leaving an inner gap costs gap_open, going on
    gap_extend; gaps at either end cost gap_terminal a column.  Places beyond a pair's own size hold what nothing reads.
    """

    def __init__(self, pairs: list[Pair]) -> None:
        self.n, self.m = np.array([p.n for p in pairs]), np.array([p.m for p in pairs])
        self.o, self.e, self.t = (np.array([[getattr(p.s, k)] for p in pairs], np.float32) for k in ("gap_open", "gap_extend", "gap_terminal"))
        self.width, self.each = int(self.m.max()), np.arange(len(pairs))
        self.j = np.arange(self.width + 1, dtype=np.float32)
        self.leave = np.repeat(self.o, self.width, 1)
        self.leave[:, 0] = 0  # a gap at the end costs nothing to leave
        self.lasts = set(self.n.tolist())
        self.ahead, self.behind = self.e * self.j, self.e * (self.j[1:] - 1)

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, x, y = (np.full((len(self.each), self.width + 1), LOW, np.float32) for _ in range(3))
        a[:, 0] = 0
        x[:, 1:] = -self.t * self.j[1:]
        return a, x, y

    def step(self, i: int, above: tuple[np.ndarray, np.ndarray, np.ndarray], score: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Row i (from 1 on), and where each cell's states come from: two bits for a match, one each for gaps that go on."""
        a0, x0, y0 = above
        o, e, t, at_m = self.o, self.e, self.t, (self.each, self.m)
        over = x0[:, :-1] if i == 1 else x0[:, :-1] - o
        under = y0[:, :-1] - self.leave
        before = a0[:, :-1]
        came = np.maximum(before, over)
        a, x, y, way = np.empty_like(a0), np.empty_like(a0), np.empty_like(a0), np.empty(a0.shape, np.uint8)
        way[:, 0] = 0
        lower = (under > came).view(np.uint8)
        np.maximum((over > before).view(np.uint8), np.add(lower, lower, out=lower), out=way[:, 1:])  # UNDER is 2 times 1
        a[:, 0] = LOW
        np.maximum(came, under, out=came)
        np.add(came, score, out=a[:, 1:])
        on, new = y0 - e, a0 - o
        on[at_m], new[at_m] = y0[at_m] - t[:, 0], a0[at_m] - t[:, 0]
        np.maximum(on, new, out=y)
        y[:, 0] = -t[:, 0] * i
        mark = (on >= new).view(np.uint8)
        way |= np.left_shift(mark, 2, out=mark)
        start, extend, ahead, behind = o, e, self.ahead, self.behind
        if i in self.lasts:
            last = (self.n == i)[:, None]
            start, extend = np.where(last, t, o), np.where(last, t, e)
            ahead, behind = extend * self.j, extend * (self.j[1:] - 1)
        run = a + ahead
        np.maximum.accumulate(run, axis=1, out=run)
        x[:, 0] = LOW
        np.subtract(run[:, :-1], behind, out=x[:, 1:])
        x[:, 1:] -= start
        mark = (x[:, :-1] - extend >= a[:, :-1] - start).view(np.uint8)
        way[:, 1:] |= np.left_shift(mark, 3, out=mark)
        return (a, x, y), way


def _back(ways: np.ndarray, floor: int, i: np.ndarray, j: np.ndarray, state: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Goes back through ways (rows from floor + 1 on) until row floor, or the origin if that is 0; steps go to out, last first."""
    each = np.arange(len(i))
    if len(i) == 1:  # one pair: plain numbers are quicker than arrays of one
        r, c, now, left, right = int(i[0]), int(j[0]), int(state[0]), [], []
        while r > floor if floor else r or c:
            way = int(ways[max(0, min(r - floor, len(ways)) - 1), 0, c])
            left.append(-1 if now == OVER else r - 1)
            right.append(-1 if now == UNDER else c - 1)
            if now == MATCH:
                r, c, now = r - 1, c - 1, way & 3
            elif now == OVER:
                now, c = OVER if r == 0 or way & 8 else MATCH, c - 1
            else:
                now, r = UNDER if c == 0 or way & 4 else MATCH, r - 1
        out.extend((np.array([p]), np.array([q])) for p, q in zip(left, right, strict=True))
        return np.array([r]), np.array([c]), np.array([now])
    while True:
        go = i > floor if floor else (i > 0) | (j > 0)
        if not go.any():
            return i, j, state
        row = np.clip(i - floor - 1, 0, len(ways) - 1)
        way = ways[row, each, j]
        take, over = go & (state == MATCH), go & (state == OVER)
        under = go & (state == UNDER)
        out.append((np.where(take | under, i - 1, -1 - ~go), np.where(take | over, j - 1, -1 - ~go)))
        nxt = np.where(take, way & 3, np.where(over, np.where((i == 0) | (way & 8 > 0), OVER, MATCH), np.where((j == 0) | (way & 4 > 0), UNDER, MATCH)))
        state = np.where(go, nxt, state)
        i, j = i - (take | under), j - (take | over)


def align_pairs(pairs: list[Pair]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Best path of each pair: places of the first side, of the second (-1: gap), and the score.

    Pairs of like size go together, CELLS cells at a time.  A pair of more cells keeps every so-many-th row and takes the
    blocks between them once more from the last on, so that memory grows with the root of its cells, at equal results.
    """
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k].n, pairs[k].m))
    at = 0
    while at < len(order):
        end, n, m = at, 0, 0
        while end < len(order):
            p = pairs[order[end]]
            n2, m2 = max(n, p.n), max(m, p.m)
            if end > at and ((n2 + 1) * (m2 + 1) * (end - at + 1) > CELLS or (m2 + 1) * (end - at + 1) > ACROSS or n2 > 2 * pairs[order[at]].n + 8):
                break
            n, m, end = n2, m2, end + 1
        some = order[at:end]
        for k, got in zip(some, _align_together([pairs[k] for k in some]), strict=True):
            out[k] = got
        at = end
    return out


def _align_together(pairs: list[Pair]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    sweep = _Sweep(pairs)
    n, m, each = int(sweep.n.max()), sweep.width, sweep.each
    block = n if (n + 1) * (m + 1) * len(pairs) <= CELLS else max(1, int(np.sqrt(n)))
    score = np.zeros((min(block, n), len(pairs), m), np.float32)

    def fill(i: int) -> np.ndarray:
        """Scores of the rows of the block from row i on."""
        for k, p in enumerate(pairs):
            z = min(i + block, p.n)
            if i < z:
                score[: z - i, k, : p.m] = p.rows(i, z)
        return score

    kept = {0: sweep.first()}
    now = kept[0]
    ends = np.zeros((3, len(pairs)), np.float32)
    ways: list[np.ndarray] = []
    for i in range(1, n + 1):
        if (i - 1) % block == 0:
            fill(i - 1)
            ways = []
        now, way = sweep.step(i, now, score[(i - 1) % block])
        ways.append(way)
        if i % block == 0 and i < n:
            kept[i] = now
        done = sweep.n == i
        if done.any():
            for x, v in enumerate(now):
                ends[x, done] = v[each[done], sweep.m[done]]
    state, total = ends.argmax(0), ends.max(0)
    i, j, steps = sweep.n.copy(), sweep.m.copy(), []
    for floor in sorted(kept, reverse=True):
        if floor != max(kept):  # the last block is at hand
            fill(floor)
            now, ways = kept[floor], []
            for r in range(floor + 1, min(floor + block, n) + 1):
                now, way = sweep.step(r, now, score[(r - 1) % block])
                ways.append(way)
        i, j, state = _back(np.stack(ways), floor, i, j, state, steps)
    left, right = (np.stack([s[x] for s in reversed(steps)]) for x in (0, 1))
    own = [left[:, k] > -2 for k in range(len(pairs))]
    return [(left[keep, k], right[keep, k], float(total[k])) for k, keep in enumerate(own)]


@dataclass
class Meeting:
    """Where the best path crosses a row of the first side: after its place `row` the path goes on from `column` of the
    second; `other` is the runner-up column and margin how much it loses."""

    row: int
    column: int
    other: int
    margin: float


def meeting(pair: Pair, row: int) -> Meeting:
    return meetings([pair], [[row]])[0][0]


def meetings(pairs: list[Pair], at: list[list[int]]) -> list[list[Meeting]]:
    """For each pair the best and the next best column at which a path may cross each of some rows, from one sweep from either
    end; the sweeps of all pairs go together.

    A path reversed costs the same, so the way back is the sweep of the reversed sides.  What meets is two matches, a match
    and a gap (which is left or entered there), or two parts of a gap (whose columns count as one run).
    """
    if not pairs:
        return []
    ahead = _rows_of_sweep(pairs, at)
    back = [Pair(p.n, p.m, lambda i, j, p=p: p.rows(p.n - j, p.n - i)[::-1, ::-1], p.s) for p in pairs]
    behind = _rows_of_sweep(back, [[p.n - r for r in rows] for p, rows in zip(pairs, at, strict=True)])
    out = []
    for k, (pair, rows) in enumerate(zip(pairs, at, strict=True)):
        o, e = np.float32(pair.s.gap_open), np.float32(pair.s.gap_extend)
        inner = np.ones(pair.m + 1, np.float32)
        inner[[0, -1]] = 0  # at either end of the second side a gap is terminal: it costs by its columns alone
        out.append([])
        for row in rows:
            (a, x, y), (ra, rx, ry) = ahead[k][row], [v[::-1] for v in behind[k][pair.n - row]]
            best = np.max([a + ra, a + rx - o, a + ry - o * inner, x + ra - o, y + ra - o * inner, y + ry - e * inner, x + rx - e], axis=0)
            first = int(best.argmax())
            rest = best.copy()
            rest[first] = LOW
            other = int(rest.argmax()) if len(rest) > 1 else first
            out[k].append(Meeting(row, first, other, float(best[first] - rest[other]) if len(rest) > 1 else float("inf")))
    return out


def _rows_of_sweep(pairs: list[Pair], at: list[list[int]]) -> list[dict[int, list[np.ndarray]]]:
    """The states of each pair at some of its rows; pairs of like size go together, CELLS scores at a time."""
    out: list[dict[int, list[np.ndarray]]] = [{} for _ in pairs]
    order, start = sorted(range(len(pairs)), key=lambda k: (pairs[k].n, pairs[k].m)), 0
    while start < len(order):
        end, n, m = start, 0, 0
        while end < len(order):
            p = pairs[order[end]]
            if end > start and (max(n, p.n) * max(m, p.m) * (end - start + 1) > CELLS or (max(m, p.m) + 1) * (end - start + 1) > ACROSS or p.n > 2 * pairs[order[start]].n + 8):
                break
            n, m, end = max(n, p.n), max(m, p.m), end + 1
        some = order[start:end]
        sweep = _Sweep([pairs[k] for k in some])
        last = max(max(at[k]) for k in some)
        now, score = sweep.first(), np.zeros((last, len(some), sweep.width), np.float32)
        for x, k in enumerate(some):
            z = min(last, pairs[k].n)
            score[:z, x, : pairs[k].m] = pairs[k].rows(0, z)
        for i in range(1, last + 1):
            now, _ = sweep.step(i, now, score[i - 1])
            for x, k in enumerate(some):
                if i in at[k]:
                    out[k][i] = [v[x, : pairs[k].m + 1].copy() for v in now]
        start = end
    return out


def through(pair: Pair, crossings: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The best path through given crossings (row, column), each part aligned by itself."""
    return through_many([(pair, crossings)])[0]


def through_many(tried: list[tuple[Pair, list[tuple[int, int]]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    parts: list[Pair] = []
    spans = []
    for pair, crossings in tried:
        ends = [(0, 0), *sorted(crossings), (pair.n, pair.m)]
        for (r0, c0), (r1, c1) in zip(ends, ends[1:], strict=False):
            spans.append((r0, c0, r1, c1))
            if r1 > r0 and c1 > c0:
                parts.append(Pair(r1 - r0, c1 - c0, lambda i, j, pair=pair, r0=r0, c0=c0, c1=c1: pair.rows(r0 + i, r0 + j)[:, c0:c1], pair.s))
    made, out, at = iter(align_pairs(parts)), [], 0
    for _, crossings in tried:
        left, right = [], []
        for r0, c0, r1, c1 in spans[at : at + len(crossings) + 1]:
            if r1 > r0 and c1 > c0:
                p, q, _ = next(made)
            else:
                p, q = np.r_[np.arange(r1 - r0), np.full(c1 - c0, -1)], np.r_[np.full(r1 - r0, -1), np.arange(c1 - c0)]
            left.append(np.where(p >= 0, p + r0, -1))
            right.append(np.where(q >= 0, q + c0, -1))
        at += len(crossings) + 1
        out.append((np.concatenate(left), np.concatenate(right)))
    return out


def trials(pairs: list[Pair], most: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each pair the best path, and paths that cross where the best one is least certain: of seven rows, those whose margin
    is under the mean are crossed at their runner-up, in turn."""
    out = [[(p, q)] for p, q, _ in align_pairs(pairs)]
    some = [k for k, p in enumerate(pairs) if most > 1 and p.n >= 4 and p.m >= 2]
    met = meetings([pairs[k] for k in some], [sorted({pairs[k].n * x // 8 for x in range(1, 8)} - {0}) for k in some])
    tried = []
    for k, own in zip(some, met, strict=True):
        mean = float(np.mean([x.margin for x in own]))
        doubtful = [x for x in own if x.margin < mean and x.other != x.column]
        tried += [(k, [(x.row, x.other)]) for x in doubtful[: most - 1]]
    for (k, _), path in zip(tried, through_many([(pairs[k], c) for k, c in tried]), strict=True):
        out[k].append(path)
    return out


def pairwise(score: np.ndarray, s: Scores) -> tuple[list[tuple[int, int]], float]:
    """Best path over a matrix of column scores: pairs (i, j), -1 for a gap on that side; and its score."""
    ((left, right, total),) = align_pairs([Pair(*score.shape, lambda i, j: score[i:j], s)])
    return list(zip(left.tolist(), right.tolist(), strict=True)), total


@dataclass
class Profile:
    members: list[int]
    grid: np.ndarray  # members x columns: residue index in its row, -1 for a gap
    counts: np.ndarray  # columns x letters


def leaf(i: int, codes: np.ndarray, letters: int) -> Profile:
    return Profile([i], np.arange(len(codes))[None, :], np.eye(letters, dtype=np.float32)[codes])


def divergence(far: np.ndarray | None, x: Profile, y: Profile) -> float:
    """Mean distance to length of the members of two sides."""
    return 0.0 if far is None else float(np.mean(far[[*x.members, *y.members]]))


def gap_factor(share: float, scale: float) -> float:
    """What gaps cost between sides so far apart: 1 less scale times the divergence, held to [0.3, 1]."""
    return min(1.0, max(0.3, 1 - scale * share))


def side_by_side(x: Profile, y: Profile, s: Scores, offset: float, bonus: np.ndarray | None = None) -> Pair:
    """Two profiles to be aligned; a pair of columns scores the mean over pairs of their members."""
    scale = np.float32(1 / (len(x.members) * len(y.members)))
    left, right = x.counts @ s.matrix.astype(np.float32), y.counts.T
    here, there = x.counts.sum(1), y.counts.sum(1)

    def rows(i: int, j: int) -> np.ndarray:
        score = left[i:j] @ right * scale
        score -= np.float32(offset) * (here[i:j, None] * there[None, :] * scale)
        return score if bonus is None else score + bonus[i:j]

    return Pair(len(x.counts), len(y.counts), rows, s)


def joined(x: Profile, y: Profile, left: np.ndarray, right: np.ndarray, rebalance: float = 0.0) -> Profile:
    """One profile of two along a path; rebalance: pseudo-count on the sizes by which the two weigh."""
    nx, ny = len(x.members), len(y.members)
    if rebalance > 0:
        wx, wy = ((nx + ny) * (n + rebalance) / ((nx + ny + 2 * rebalance) * n) for n in (nx, ny))
        x, y = replace(x, counts=x.counts * np.float32(wx)), replace(y, counts=y.counts * np.float32(wy))
    put = lambda p, at: np.where(at >= 0, p.grid[:, np.maximum(at, 0)], -1)
    add = lambda p, at: np.where((at >= 0)[:, None], p.counts[np.maximum(at, 0)], 0)
    return Profile(x.members + y.members, np.vstack([put(x, left), put(y, right)]), add(x, left) + add(y, right))


def merge(x: Profile, y: Profile, s: Scores, offset: float, bonus: np.ndarray | None = None) -> tuple[Profile, float]:
    ((left, right, total),) = align_pairs([side_by_side(x, y, s, offset, bonus)])
    return joined(x, y, left, right), total


def rows_of(p: Profile, seqs: list[str]) -> list[str]:
    out = [""] * len(seqs)
    for member, row in zip(p.members, _rows(p, seqs), strict=True):
        out[member] = row
    return out


def _rows(p: Profile, seqs: list[str]) -> list[str]:
    """The members' rows of text, in the order of the profile."""
    own = [seqs[m] for m in p.members]
    whole = "".join(own) + "-"
    if not whole.isascii():
        return ["".join(seqs[m][k] if k >= 0 else "-" for k in places.tolist()) for m, places in zip(p.members, p.grid, strict=True)]
    start = np.cumsum([0, *map(len, own[:-1])])
    text = np.frombuffer(whole.encode(), np.uint8)[np.where(p.grid >= 0, p.grid + start[:, None], len(whole) - 1)].tobytes().decode()
    width = p.grid.shape[1]
    return [text[i * width : (i + 1) * width] for i in range(len(own))]


def consistency_maps(families: list[list[np.ndarray]], scores: list[Scores], count: int, anchors: list[list[int]]) -> list[list[list[np.ndarray]]]:
    """For each family maps[i][k][p]: the residue of anchor k that residue p of sequence i is aligned to, or -1."""
    pairs, places = [], []
    out = []
    for f, (codes, s) in enumerate(zip(families, scores, strict=True)):
        out.append([])
        if len(codes) < 3 or count < 1:
            continue
        eye, matrix = np.eye(len(s.letters), dtype=np.float32), s.matrix.astype(np.float32)
        for i, c in enumerate(codes):
            out[f].append([np.arange(len(c)) if k == i else np.full(len(c), -1, np.int64) for k in anchors[f]])
            for x, k in enumerate(anchors[f]):
                if k != i:
                    left, right = eye[c] @ matrix, eye[codes[k]].T
                    pairs.append(Pair(len(c), len(codes[k]), lambda a, b, left=left, right=right: left[a:b] @ right, s))
                    places.append((f, i, x))
    for (f, i, x), (p, q, _) in zip(places, align_pairs(pairs), strict=True):
        both = (p >= 0) & (q >= 0)
        out[f][i][x][p[both]] = q[both]
    return out


def consistency_bonus(x: Profile, y: Profile, maps: np.ndarray | None, weight: float) -> np.ndarray | None:
    """For columns of both: the share of members that an anchor residue joins, summed over anchors.

    maps: sequences x anchors x places, -1 beyond a sequence's end (as a padded array of consistency_maps).
    """
    if maps is None:
        return None
    k = maps.shape[1]
    out = np.zeros((x.grid.shape[1], y.grid.shape[1]), np.float32)
    to = [_met(p, maps) for p in (x, y)]
    widths = np.maximum(to[0].max((1, 2), initial=-1), to[1].max((1, 2), initial=-1)) + 1
    most = int(widths.max())
    if most < 1:
        return out
    votes = [_votes(p, t, most) for p, t in zip((x, y), to, strict=True)]
    for a in np.flatnonzero(widths):
        w = int(widths[a])
        out += np.float32(weight / k) * (votes[0][a, :, :w] @ votes[1][a, :, :w].T)
    return out


def _met(p: Profile, maps: np.ndarray) -> np.ndarray:
    """anchors x members x columns: the anchor's residue that a member's residue there is aligned to, or -1."""
    got = np.take_along_axis(maps[p.members], np.maximum(p.grid, 0)[:, None, :], 2)
    return np.where(p.grid[:, None, :] >= 0, got, -1).transpose(1, 0, 2)


def _votes(p: Profile, to: np.ndarray, width: int) -> np.ndarray:
    """anchors x columns x places of an anchor: the share of members there, each member's added in turn."""
    k, n, cols = to.shape
    a, m, c = np.nonzero(to >= 0)
    count = np.bincount((a * cols + c) * width + to[a, m, c], minlength=k * cols * width)
    steps = np.zeros(n + 1, np.float32)
    steps[1:] = np.add.accumulate(np.full(n, 1 / n, np.float32))
    return steps[count].reshape(k, cols, width)


def _padded(maps: list[list[np.ndarray]]) -> np.ndarray | None:
    if not maps:
        return None
    out = np.full((len(maps), len(maps[0]), max(1, max(len(own[0]) for own in maps))), -1, np.int32)
    for i, own in enumerate(maps):
        out[i, :, : len(own[0])] = own
    return out


@dataclass(frozen=True)
class Options:
    kind: str = ""  # a type of scoring.PROTEINS or NUCLEOTIDES, 'pfasum_auto', or '' for the default of what the letters are
    matrix: str = ""  # a file of protein scores in place of the rule's
    gap_open: float = -1.0
    gap_extend: float = -1.0
    gap_terminal: float = -1.0
    consistency: int = 0
    consistency_weight: float = 2.0
    refine: str = "none"  # none, confident, all, inline
    adaptive_budget: bool = False  # inline: more trials where more merges are doubtful
    realign: int = 0
    ensemble: int = 0
    min_support: int = 0
    seed: int = 42
    gap_scale: float = 0.0  # how much milder gaps get with the distance of the two sides
    vsm_amax: float = -1.0  # offset of residue scores for near sides; below 0: the type's own
    rebalance: float = 0.0  # pseudo-count that draws the weights of two merged sides together; 0: by their sizes


# fixed values: presets, and gap factors and tree noise of the runs of an ensemble
MODES = {"fast": Options(), "default": Options(consistency=5), "precise": Options(ensemble=3, realign=1)}
RUNS = (
    (1.0, 1.0, 1.0, 0.0), (0.5, 1.5, 0.8, 0.20), (1.5, 0.5, 1.2, 0.20), (0.7, 0.7, 0.5, 0.25), (1.4, 1.4, 1.5, 0.25), (0.8, 1.2, 1.0, 0.30),
    (1.3, 0.8, 0.7, 0.30), (0.6, 1.0, 1.3, 0.15), (1.0, 0.6, 0.6, 0.15), (1.8, 1.0, 1.0, 0.35), (1.0, 1.8, 1.8, 0.35), (0.4, 0.4, 0.3, 0.20),
)


@dataclass
class Job:
    """A family on its way up its tree."""

    seqs: list[str]
    s: Scores
    tree: list[tuple[int, int, int]]
    offset: float = 0.0  # mean offset of the merges, for what is re-aligned later
    far: np.ndarray | None = None  # each sequence's mean distance to anchors, to its length


def progressive(seqs: list[str], s: Scores, tree: list[tuple[int, int, int]], o: Options) -> list[str]:
    return progressive_many([Job(seqs, s, tree)], o)[0]


def progressive_many(jobs: list[Job], o: Options) -> list[list[str]]:
    """Aligned rows of each family; merges whose two sides are ready are aligned together, over all families."""
    far = _embeddings(jobs, bool(o.gap_scale) or o.vsm_amax > 0)
    most = lambda job: o.vsm_amax if o.vsm_amax >= 0 else job.s.offset_most
    for job, d in zip(jobs, far, strict=True):
        if d is not None:  # the more alike the sides, the more a chance match would have to score
            job.far = d.mean(1) / np.maximum(1, np.array([len(x) for x in job.seqs]))
            job.offset = max(0.0, most(job) - float(job.far.mean()))

    def pair(k: int, x: Profile, y: Profile, bonus: np.ndarray | None) -> Pair:
        job = jobs[k]
        share = divergence(job.far, x, y)
        f = gap_factor(share, o.gap_scale) if o.gap_scale else 1.0
        return side_by_side(x, y, job.s.scaled(f, f, f) if f < 1 else job.s, max(0.0, most(job) - share) if job.far is not None else 0.0, bonus)

    codes = [[j.s.codes(x) for x in j.seqs] for j in jobs]
    near = far
    if o.consistency:  # what is not embedded yet, all families together
        rest = [k for k, d in enumerate(far) if d is None and len(jobs[k].seqs) > 2]
        got = dict(zip(rest, trees.embed_many([jobs[k].seqs for k in rest]), strict=True))
        near = [got.get(k, d) for k, d in enumerate(far)]
    anchors = [trees.spread_anchors(j.seqs, d, o.consistency) if o.consistency else [] for j, d in zip(jobs, near, strict=True)]
    maps = [_padded(m) for m in consistency_maps(codes, [j.s for j in jobs], o.consistency, anchors)]
    nodes = [{i: leaf(i, c, len(j.s.letters)) for i, c in enumerate(own)} for j, own in zip(jobs, codes, strict=True)]
    margins: list[list[float]] = [[0.0] * len(j.tree) for j in jobs]
    left = [list(range(len(j.tree))) for j in jobs]
    while any(left):
        ready = [(k, e) for k, job in enumerate(jobs) for e in left[k] if job.tree[e][0] in nodes[k] and job.tree[e][1] in nodes[k]]
        sides = [(nodes[k].pop(jobs[k].tree[e][0]), nodes[k].pop(jobs[k].tree[e][1])) for k, e in ready]
        pairs = [pair(k, x, y, consistency_bonus(x, y, maps[k], o.consistency_weight)) for (k, _), (x, y) in zip(ready, sides, strict=True)]
        turns: dict[int, list[tuple[int, int, Profile, float]]] = defaultdict(list)  # a family's merges follow one another
        seen: dict[int, int] = defaultdict(int)
        for (k, e), (x, y), (p, q, total) in zip(ready, sides, align_pairs(pairs), strict=True):
            turns[seen[k]].append((k, e, joined(x, y, p, q, o.rebalance), total / max(1, min(x.grid.shape[1], y.grid.shape[1]))))
            seen[k] += o.refine == "inline"
        for _, some in sorted(turns.items()):
            for k, e, _, margin in some:
                margins[k][e] = margin
            large = [(k, e, got) for k, e, got, _ in some if o.refine == "inline" and len(got.members) > 2]
            made = {(k, e): x for (k, e, _), x in zip(large, inline_many([(got, jobs[k], margins[k]) for k, _, got in large], o.adaptive_budget), strict=True)}
            for k, e, got, _ in some:
                if (k, e) in made:
                    got, margins[k][e] = made[k, e]
                nodes[k][jobs[k].tree[e][2]] = got
        taken = set(ready)
        left = [[e for e in own if (k, e) not in taken] for k, own in enumerate(left)]
    out = []
    for job, own in zip(jobs, nodes, strict=True):
        (root,) = own.values()
        out.append(rows_of(root, job.seqs))
    return refine_many(out, jobs, margins, o.refine) if o.refine in ("confident", "all") else out


def budget(margins: list[float], adaptive: bool, trials: int = 3) -> int:
    """Trials of a merge: three, or, if adaptive, one and up to seven by the share of merges so far with under a quarter of
    their mean margin."""
    if not adaptive:
        return trials
    known = [m for m in margins if m]
    mean = float(np.mean(known)) if known else 0.0
    return 1 + round(7 * sum(m < mean / 4 for m in known) / max(1, len(known)))


def inline_many(merges: list[tuple[Profile, Job, list[float]]], adaptive: bool) -> list[tuple[Profile, float]]:
    """Merged profiles (with their families and the margins so far) after trials that each take one side of a merge below out
    and align it to the rest again; the least certain merges first, what scores higher stays.  Also the score of each, which
    from then on stands for its certainty.  Trials of one merge follow one another; those of others go with them.
    """
    states = []
    for whole, job, margins in merges:
        inside = set(whole.members)
        below: dict[int, list[int]] = {i: [i] for i in inside}
        edges = []
        for e, (a, b, c) in enumerate(job.tree):
            if a in below and b in below:
                below[c] = below[a] + below[b]
                if len(below[c]) < len(inside):
                    edges.append((margins[e], a))
        rows = dict(zip(whole.members, _rows(whole, job.seqs), strict=True))
        states.append([sorted(inside), below, sorted(edges)[: budget(margins, adaptive)], rows, sum_of_pairs(list(rows.values()), job.s)])
    for turn in range(max((len(x[2]) for x in states), default=0)):
        some = [k for k, x in enumerate(states) if turn < len(x[2])]
        halves = []
        for k in some:
            own, below, edges, rows, _ = states[k]
            texts, side = [rows[m] for m in own], set(below[edges[turn][1]])
            halves.append([_profile_of(texts, [i for i, m in enumerate(own) if (m in side) == first], merges[k][1].s) for first in (True, False)])
        paths = align_pairs([side_by_side(*h, merges[k][1].s, merges[k][1].offset) for k, h in zip(some, halves, strict=True)])
        for k, h, (left, right, _) in zip(some, halves, paths, strict=True):
            own, job = states[k][0], merges[k][1]
            tried = rows_of(joined(*h, left, right), [job.seqs[m] for m in own])
            score = sum_of_pairs(tried, job.s)
            if score > states[k][4] + 1e-6:
                states[k][3:] = [dict(zip(own, tried, strict=True)), score]
    out = []
    for (whole, job, _), (_, _, _, rows, best) in zip(merges, states, strict=True):
        made = _profile_of([rows[m] for m in whole.members], list(range(len(whole.members))), job.s)
        out.append((Profile(list(whole.members), made.grid, made.counts), best))
    return out


def _embeddings(jobs: list[Job], every: bool) -> list[np.ndarray | None]:
    some = [k for k, j in enumerate(jobs) if (j.s.offset_most or every) and len(j.seqs) > 1]
    got = dict(zip(some, trees.embed_many([jobs[k].seqs for k in some]), strict=True))
    return [got.get(k) for k in range(len(jobs))]


def sum_of_pairs(rows: list[str], s: Scores) -> float:
    """Pair score of an alignment from letter counts of columns; a residue against a gap costs gap_extend."""
    n = len(rows)
    counts = _counts(np.frombuffer("".join(rows).encode(), np.uint8).reshape(n, -1), s).astype(np.float64)
    present = counts.sum(1)
    same = ((counts @ s.matrix * counts).sum(1) - counts @ np.diag(s.matrix)) / 2
    return float(same.sum() - s.gap_extend * (present * (n - present)).sum())


def _counts(grid: np.ndarray, s: Scores) -> np.ndarray:
    """columns x letters: how often each letter stands in each column of rows of ASCII text."""
    row, col = np.nonzero(grid != ord("-"))
    return np.bincount(col * len(s.letters) + code_table(s.letters)[grid[row, col]], minlength=grid.shape[1] * len(s.letters)).reshape(-1, len(s.letters))


TRIALS = 5


def merge_score(x: Profile, y: Profile, left: np.ndarray, right: np.ndarray, s: Scores) -> float:
    """Sum of pairs between the members of two sides along a path: residue scores, gap_open for each run of gap columns, and
    gap_extend, or gap_terminal at the ends, for each residue that faces a gap of the other side."""
    both = (left >= 0) & (right >= 0)
    total = float(((x.counts[left[both]] @ s.matrix) * y.counts[right[both]]).sum())
    nx, ny = len(x.members), len(y.members)
    facing = np.where(left < 0, y.counts[np.maximum(right, 0)].sum(1) * nx, np.where(right < 0, x.counts[np.maximum(left, 0)].sum(1) * ny, 0.0))
    inner = np.flatnonzero(both)
    first, last = (inner[0], inner[-1]) if len(inner) else (len(left), -1)
    at_end = (np.arange(len(left)) < first) | (np.arange(len(left)) > last)
    kind = np.where(both, 0, np.where(left < 0, 1, 2))
    opens = (kind > 0) & (np.r_[0, kind[:-1]] != kind) & ~at_end
    return total - float((facing * np.where(at_end, s.gap_terminal, s.gap_extend)).sum()) - s.gap_open * nx * ny * int(opens.sum())


def refine_many(aligned: list[list[str]], jobs: list[Job], margins: list[list[float]], mode: str) -> list[list[str]]:
    """Takes each alignment apart at tree edges and aligns the halves again; keeps what scores higher.

    'confident': edges whose merge scored no more than the median; 'all': every edge.  An edge has TRIALS trials: the best
    path of its sides, and paths that cross at runners-up of uncertain places.  A family's edges follow one another; those
    of other families go with them.
    """
    rows = [list(r) for r in aligned]
    best = [sum_of_pairs(r, j.s) for r, j in zip(rows, jobs, strict=True)]
    turns = [_edges(j, m, mode) for j, m in zip(jobs, margins, strict=True)]
    for turn in range(max(map(len, turns), default=0)):
        some = [k for k, t in enumerate(turns) if turn < len(t)]
        halves = [[_profile_of(rows[k], side, jobs[k].s) for side in turns[k][turn]] for k in some]
        tried = trials([side_by_side(*h, jobs[k].s, jobs[k].offset) for k, h in zip(some, halves, strict=True)], TRIALS)
        for k, h, paths in zip(some, halves, tried, strict=True):
            for left, right in paths:
                got = rows_of(joined(*h, left, right), jobs[k].seqs)
                score = sum_of_pairs(got, jobs[k].s)
                if score > best[k] + 1e-6:
                    rows[k], best[k] = got, score
    return rows


def _edges(job: Job, margins: list[float], mode: str) -> list[tuple[list[int], list[int]]]:
    """The two sides of each tree edge that is to be tried, in the order of the tree."""
    n = len(job.seqs)
    below: dict[int, list[int]] = {i: [i] for i in range(n)}
    for a, b, c in job.tree:
        below[c] = below[a] + below[b]
    limit = float(np.median(margins)) if margins else 0.0
    out = []
    for (a, b, _), margin in zip(job.tree[:-1], margins, strict=False):
        if mode == "confident" and margin > limit:
            continue
        for node in (a, b):
            inside = set(below[node])
            if len(inside) < n:
                out.append((sorted(inside), [i for i in range(n) if i not in inside]))
    return out


def _profile_of(rows: list[str], members: list[int], s: Scores) -> Profile:
    letters = np.frombuffer("".join(rows[i] for i in members).encode(), np.uint8).reshape(len(members), -1)
    letters = letters[:, (letters != ord("-")).any(0)]
    grid = letters != ord("-")
    places = np.where(grid, np.cumsum(grid, axis=1) - 1, -1)
    return Profile(list(members), places, _counts(letters, s).astype(np.float32))


def support_table(alignments: list[list[str]]) -> dict[tuple[int, int, int, int], int]:
    """(i, j, pos_i, pos_j) -> bits of the alignments that put the two residues in one column."""
    out: dict[tuple[int, int, int, int], int] = defaultdict(int)
    for run, rows in enumerate(alignments):
        grid = np.array([np.frombuffer(r.encode(), np.uint8) for r in rows]) != ord("-")
        places = np.where(grid, np.cumsum(grid, axis=1) - 1, -1)
        for c in range(places.shape[1]):
            here = [(i, int(p)) for i, p in enumerate(places[:, c]) if p >= 0]
            for x, (i, p) in enumerate(here):
                for j, q in here[x + 1 :]:
                    out[i, j, p, q] |= 1 << run
    return out


def run_score(rows: list[str], support: dict[tuple[int, int, int, int], int], runs: int) -> float:
    own = support_table([rows])
    return sum((support.get(k, 0).bit_count() - 1) / max(1, runs - 1) for k in own)


def consensus(seqs: list[str], support: dict[tuple[int, int, int, int], int], least: int) -> list[str]:
    """Greedy columns from residue pairs of enough support, most supported first.

    Two columns become one unless they hold residues of one sequence or one must come before the other.
    """
    start = np.cumsum([0, *[len(x) for x in seqs]])
    column = list(range(int(start[-1])))  # residue -> column
    owner = [i for i, x in enumerate(seqs) for _ in x]
    members: dict[int, list[int]] = {r: [r] for r in column}

    def later(c: int) -> set[int]:
        return {column[r + 1] for r in members[c] if r + 1 < len(owner) and owner[r + 1] == owner[r]}

    def comes_before(a: int, b: int) -> bool:
        seen, queue = {a}, deque([a])
        while queue:
            for nxt in later(queue.popleft()):
                if nxt == b:
                    return True
                if nxt not in seen:
                    seen.add(nxt)
                    queue.append(nxt)
        return False

    order = sorted((k for k, m in support.items() if m.bit_count() >= least), key=lambda k: (-support[k].bit_count(), k))
    for i, j, p, q in order:
        a, b = column[int(start[i]) + p], column[int(start[j]) + q]
        if a == b or {owner[r] for r in members[a]} & {owner[r] for r in members[b]} or comes_before(a, b) or comes_before(b, a):
            continue
        for r in members[b]:
            column[r] = a
        members[a] += members.pop(b)
    return _lined(seqs, column)


def consensus_of_runs(seqs: list[str], runs: list[list[str]], least: int) -> list[str]:
    """consensus of the runs' support_table.

    Residues that share a column in every run are never at odds: no column of any run holds two residues of a sequence, and
    all of them stand in the order of each run.  So where all runs have to agree, these classes are the columns, and no pair
    is made.
    """
    if least < len(runs):
        return consensus(seqs, support_table(runs), least)
    start = np.cumsum([0, *[len(x) for x in seqs]])
    same = np.zeros(int(start[-1]), np.int64)
    for rows in runs if least == len(runs) else []:
        at = np.concatenate([np.flatnonzero(np.frombuffer(r.encode(), np.uint8) != ord("-")) for r in rows])
        same = np.unique(same * (int(at.max(initial=0)) + 1) + at, return_inverse=True)[1]
    return _lined(seqs, (same if least == len(runs) else np.arange(len(same))).tolist())


def _lined(seqs: list[str], column: list[int]) -> list[str]:
    """Rows from the column of each residue: columns in an order that all sequences keep, of those ready the one of the least
    residue first."""
    import heapq

    n = len(column)
    ends = set(np.cumsum([len(x) for x in seqs]).tolist())
    members: dict[int, list[int]] = {}
    for r, c in enumerate(column):
        members.setdefault(c, []).append(r)
    later = {c: {column[r + 1] for r in own if r + 1 < n and r + 1 not in ends} for c, own in members.items()}
    waits = dict.fromkeys(members, 0)
    for after in later.values():
        for c in after:
            waits[c] += 1
    ready = [(members[c][0], c) for c, w in waits.items() if not w]
    heapq.heapify(ready)
    place: dict[int, int] = {}
    while ready:
        _, c = heapq.heappop(ready)
        place[c] = len(place)
        for nxt in later[c]:
            waits[nxt] -= 1
            if not waits[nxt]:
                heapq.heappush(ready, (members[nxt][0], nxt))
    out = [["-"] * len(place) for _ in seqs]
    r = 0
    for x, row in zip(seqs, out, strict=True):
        for ch in x:
            row[place[column[r]]] = ch
            r += 1
    return ["".join(x) for x in out]


def align_family(names: list[str], seqs: list[str], o: Options = MODES["fast"]) -> list[str]:
    """Aligned rows in the order given.  The order of input and the run's partition do not change them."""
    return align_families([(names, seqs)], o)[0]


def align_families(families: list[tuple[list[str], list[str]]], o: Options = MODES["fast"]) -> list[list[str]]:
    """align_family of each (names, seqs); pairs of all families go through the recurrence together."""
    places, own = [], []
    for names, seqs in families:
        order = sorted(range(len(seqs)), key=lambda i: (-len(seqs[i]), names[i], seqs[i], i))
        places.append([i for i in order if seqs[i]])
        own.append([seqs[i] for i in places[-1]])
    many = [k for k, x in enumerate(own) if len(x) > 1]
    types = [type_for(o.kind, own[k]) for k in many]
    matrix = matrix_file(o.matrix, PROTEIN) if o.matrix else None
    scores = [scores_for(t, o.gap_open, o.gap_extend, o.gap_terminal, matrix if t in PROTEINS else None) for t in types]
    made = dict(zip(many, (_ensemble if o.ensemble else _once)([own[k] for k in many], scores, o), strict=True))
    out = []
    for k, (_, seqs) in enumerate(families):
        if k in made:
            width = len(made[k][0])
            rows = ["-" * width] * len(seqs)
            for i, r in zip(places[k], made[k], strict=True):
                rows[i] = r
        else:
            width = max(map(len, seqs), default=0)
            rows = [x.ljust(width, "-") for x in seqs]
        out.append(rows)
    return out


def _once(own: list[list[str]], scores: list[Scores], o: Options, noise: float = 0.0, seed: int | None = None) -> list[list[str]]:
    seed = o.seed if seed is None else seed
    grown = trees.guide_trees(own, [seed] * len(own), noise)
    rows = progressive_many([Job(x, s, t) for x, s, t in zip(own, scores, grown, strict=True)], o)
    for _ in range(o.realign):
        grown = [trees.linkage(trees.identity_distances(r), list(range(len(x))), len(x)) for r, x in zip(rows, own, strict=True)]
        rows = progressive_many([Job(x, s, t) for x, s, t in zip(own, scores, grown, strict=True)], o)
    return rows


def _ensemble(own: list[list[str]], types: list[Scores], o: Options) -> list[list[str]]:
    """Of each family the consensus of its runs, or the best of them."""
    made = []
    for k in range(o.ensemble):
        a, b, c, noise = RUNS[k % len(RUNS)]
        made.append(_once(own, [s.scaled(a, b, c) for s in types], o, noise, o.seed + k))
    support = [support_table([run[f] for run in made]) for f in range(len(own))]
    if o.min_support:
        return [consensus(x, held, o.min_support) for x, held in zip(own, support, strict=True)]
    out, best, scored = [], [], []
    for f, held in enumerate(support):
        scores = [run_score(run[f], held, o.ensemble) for run in made]
        top = 0
        for k in range(1, o.ensemble):
            if scores[k] > scores[top] and scores[k] > 1.05 * scores[0]:
                top = k
        best.append(top)
        scored.append(scores[top])
        out.append(made[top][f])
    # the winner once more with its doubtful edges re-aligned, if its pairs are then better supported
    for k in sorted(set(best)):
        some = [f for f, top in enumerate(best) if top == k]
        a, b, c, noise = RUNS[k % len(RUNS)]
        again = _once([own[f] for f in some], [types[f].scaled(a, b, c) for f in some], replace(o, refine="confident"), noise, o.seed + k)
        for f, rows in zip(some, again, strict=True):
            if run_score(rows, support[f], o.ensemble) > scored[f]:
                out[f] = rows
    return out


def generate_family(n: int, length: int, seed: int, dna: bool = False, indel: float = 0.04) -> list[str]:
    """Sequences drawn from one profile with substitutions, insertions and deletions."""
    return [r.replace("-", "") for r in generate_alignment(n, length, seed, dna, indel)]


def generate_alignment(n: int, length: int, seed: int, dna: bool = False, indel: float = 0.04) -> list[str]:
    """A family and its true alignment, from a chain of match, insert and delete states.

    Each of `length` match states has letter chances of its own; from a match or insert a sequence goes to an insert, and
    from a match or delete to a delete, with the chance `indel` (half of it for over 100 sequences).  Inserts of one place
    share columns, left-justified.  A sequence of no letter gets one.
    """
    rng = np.random.default_rng(seed)
    letters = "ACGT" if dna else "ACDEFGHIKLMNPQRSTVWY"
    profile = rng.dirichlet(np.full(len(letters), 0.15), length)
    if n > 100:
        indel /= 2
    drawn: list[list[tuple[str, str]]] = []  # for each place the letter of its match, and what is inserted after it
    for _ in range(n):
        row = []
        for p in profile:
            x = rng.random()
            match = "" if x < indel else letters[rng.choice(len(letters), p=p)]
            inserted = ""
            while match and rng.random() < indel:
                inserted += letters[rng.integers(len(letters))]
            row.append((match, inserted))
        if not any(m for m, _ in row):
            row[0] = (letters[0], "")
        drawn.append(row)
    widest = [max(len(row[k][1]) for row in drawn) for k in range(length)]
    return ["".join((m or "-") + i.ljust(w, "-") for (m, i), w in zip(row, widest, strict=True)) for row in drawn]
