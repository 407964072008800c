"""Pairs of fingerprints within a Hamming radius, and the components that such links make.

Two ways to cells in which close fingerprints meet:

* multi-index hashing: the bits are cut into segments.  Two fingerprints within radius r differ in at most
  r // segments bits of some segment, so each is filed under its own segment value (at home) and under every value of
  the small ball around it (as a visitor); pairs with one at home are verified over all bits.
* permuted block tables: with radius + 1 blocks, two fingerprints within the radius agree on some block; each table
  brings another block to the front and buckets by it.

A cell of more than CELL_ROWS rows is dealt out by pairs of salted blocks, so that any two of its rows meet in one
bounded cell and no group goes to one task whole.  Cells emit spanning links or counts, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import cut, parts

CELL_ROWS = 2048
#: A list of oversized cells up to this length (24 bytes each) is broadcast; a longer one is joined by shuffle.
HOT_CELLS_BROADCAST = 100_000


def segment_bounds(bits: int, segments: int) -> list[tuple[int, int]]:
    """(shift, width) of near-equal segments."""
    cuts = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(col: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(col, shift).bitwiseAND(F.lit((1 << width) - 1))


def segments_for(count: int, radius: int) -> int:
    """As few segments as leave balls of one bit; two of 32 bits for more than 2^27 fingerprints, to keep cells small."""
    return max(1, radius // 2 + 1) if count < 1 << 27 or radius > 5 else 2


def multi_index(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """cell, home, w0 for fingerprints in the 64-bit column w0."""
    ball, filed = radius // segments, []
    for s, (shift, width) in enumerate(segment_bounds(64, segments)):
        own = _segment(F.col("w0"), shift, width)
        tag = F.lit(s << 48)
        masks = F.array(F.lit(0).cast("long"))
        if ball == 1:
            # of two values one bit apart, the one with the zero visits the other
            flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
            masks = F.concat(masks, F.filter(flips, lambda m: own.bitwiseAND(m) == 0))
        elif ball > 1:
            near = [m for m in _ball(width, ball)]
            masks = F.concat(masks, F.array(*[F.lit(m).cast("long") for m in near]))
        filed.append(_filed(masks, own, tag))
    return fps.select("w0", F.explode(F.concat(*filed)).alias("c")).select("c.cell", "c.home", "w0")


def _filed(masks: Column, own: Column, tag: Column) -> Column:
    return F.transform(masks, lambda m: F.struct(own.bitwiseXOR(m).bitwiseOR(tag).alias("cell"), (m == 0).alias("home")))


def _ball(width: int, radius: int) -> Iterator[int]:
    from itertools import combinations

    for k in range(1, radius + 1):
        for bits in combinations(range(width), k):
            yield sum(1 << b for b in bits)


def block_tables(fps: DataFrame, radius: int, words: int) -> DataFrame:
    """cell, home, w0.. : radius + 1 tables, each led by another block of the words * 64 bits."""
    per = (radius + 1) // words
    if per * words != radius + 1 or per > 8:
        raise ValueError("radius + 1 must be a multiple of the number of words, with at most eight blocks a word")
    cols, tables = [f"w{i}" for i in range(words)], []
    for t in range(radius + 1):
        shift, width = segment_bounds(64, per)[t % per]
        lead = _segment(F.col(cols[t // per]), shift, width)
        tables.append(F.struct(F.xxhash64(F.lit(t), lead).alias("cell"), F.lit(True).alias("home"), F.lit(t).alias("table")))
    return fps.select(*cols, F.explode(F.array(*tables)).alias("c")).select("c.cell", "c.home", "c.table", *cols)


def deal(rows: DataFrame, words: int) -> DataFrame:
    """Adds sub: 0 for cells of bounded size; for larger ones a row goes to every pair of blocks that holds its own."""
    sizes = rows.groupBy("cell").count().filter(F.col("count") > CELL_ROWS)
    hot = cut(sizes.select(F.col("cell").alias("hot_cell"), F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("blocks")))
    if hot.limit(1).count() == 0:
        return rows.withColumn("sub", F.lit(0).cast("long")).withColumn("block", F.lit(0))
    hot = F.broadcast(hot) if hot.count() <= HOT_CELLS_BROADCAST else hot
    block = F.pmod(F.xxhash64(*[f"w{i}" for i in range(words)], F.lit(7)), F.col("blocks")).cast("int")
    joined = rows.join(hot, rows["cell"] == hot["hot_cell"], "left").withColumn("block", F.coalesce(block, F.lit(0)))
    # pair (i, j), i <= j, as i * 2^20 + j + 1
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(j, F.col("block")).cast("long") * (1 << 20) + F.greatest(j, F.col("block")) + 1,
    )
    subs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return joined.withColumn("sub", F.explode(subs)).select(*rows.columns, "sub", "block")


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    total = np.bitwise_count(a[0] ^ b[0]).astype(np.uint16)
    for x, y in zip(a[1:], b[1:], strict=False):
        total = total + np.bitwise_count(x ^ y)
    return total


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns and group starts of whole (cell, sub) groups; the last group of a batch waits for the next."""
    kept: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names}
        if kept is not None:
            now = {k: np.concatenate([kept[k], now[k]]) for k in names}
        cell, sub = now["cell"], now["sub"]
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1])])
        last = starts[-1]
        kept = {k: v[last:] for k, v in now.items()}
        if last:
            yield {k: v[:last] for k, v in now.items()}, np.r_[starts[:-1], last]
    if kept is not None:
        yield kept, np.array([0, len(kept["cell"])])


class Forest:
    """Union-find over the values seen in one task's batch."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r and x != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def small_pairs(starts: np.ndarray, homes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (home, any later row) of groups with at most `most` rows, rows sorted home first; and the larger groups."""
    size = np.diff(starts)
    use = np.flatnonzero((size > 1) & (homes > 0) & (size <= most))
    large = np.flatnonzero((size > most) & (homes > 0))
    if not len(use):
        none = np.zeros(0, np.int64)
        return none, none, large
    h = homes[use]
    group = np.repeat(use, h)
    first = np.repeat(np.cumsum(h) - h, h)
    a = starts[group] + (np.arange(len(group)) - first)
    later = starts[group + 1] - 1 - a
    left = np.repeat(a, later)
    right = left + 1 + (np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later))
    return left, right, large


def link_cells(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning links (a, b) between fingerprints of a cell; within one batch a tree for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in _groups(batches, ["cell", "sub", "home", "w0"]):
            fp, home = cols["w0"].view(np.uint64), cols["home"].astype(bool)
            forest = Forest()
            order = np.lexsort((~home, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            fp, home = fp[order], home[order]
            homes = np.add.reduceat(home.astype(np.int64), starts[:-1])
            left, right, large = small_pairs(starts, homes, 64)
            for i in range(0, len(left), 1 << 21):
                a, b = fp[left[i : i + (1 << 21)]], fp[right[i : i + (1 << 21)]]
                close = (np.bitwise_count(a ^ b) <= radius) & (a != b)
                for x, y in zip(a[close].view(np.int64).tolist(), b[close].view(np.int64).tolist(), strict=False):
                    forest.join(x, y)
            for g in large:
                _span(fp[starts[g] : starts[g + 1]], home[starts[g] : starts[g + 1]], radius, forest)
            stars = forest.stars()
            if stars:
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["a", "b"])

    return run


def _span(fp: np.ndarray, home: np.ndarray, radius: int, forest: Forest) -> None:
    """Breadth first: each row is compared with the rows not reached yet, so the work has no pairs of reached rows."""
    seen, at = np.unique(fp, return_index=True)
    is_home = np.zeros(len(seen), bool)
    is_home[np.searchsorted(seen, fp[home])] = True
    left = np.arange(len(seen))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(seen[left] ^ seen[x]) <= radius
            if not is_home[x]:
                close &= is_home[left]
            found, left = left[close], left[~close]
            for y in found.tolist():
                forest.join(int(seen[x].view(np.int64)), int(seen[y].view(np.int64)))
            queue.extend(found.tolist())


def links(fps: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """fps: distinct non-null 64-bit fingerprints in w0.  Links (a, b) whose components are those of all pairs within the radius."""
    # the rows come from an aggregate's few partitions and make many each; dealt by w0 itself they would stay where they are
    spread = fps.repartition(parts(fps.sparkSession), F.xxhash64("w0"))
    rows = deal(multi_index(spread, radius, segments or segments_for(fps.count(), radius)), 1)
    dealt = rows.repartition(parts(fps.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub")
    return dealt.select("cell", "sub", "home", "w0").mapInArrow(link_cells(radius), "a long, b long")


def count_cells(radius: int, words: int, block_of: list[tuple[int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row the number of others within the radius that meet it in no earlier table."""
    names = [f"w{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in _groups(batches, ["cell", "sub", "table", "block", *names]):
            fp = [cols[n].view(np.uint64) for n in names]
            count = np.zeros(len(fp[0]), np.int64)
            sizes = np.diff(starts)
            left, right, large = small_pairs(starts, sizes, 64)

            def met(a, b, of):  # pairs that count here: in radius, same lead (no hash collision), no earlier table, right pair of blocks
                x, y = [w[a] for w in fp], [w[b] for w in fp]
                ok = distances(x, y) <= radius
                t = cols["table"][of]
                sub = cols["sub"][of]
                lo, hi = np.minimum(cols["block"][a], cols["block"][b]), np.maximum(cols["block"][a], cols["block"][b])
                ok &= (sub == 0) | (sub == lo.astype(np.int64) * (1 << 20) + hi + 1)
                for k, (w, shift, mask) in enumerate(block_of):
                    same = ((x[w] ^ y[w]) >> np.uint64(shift)) & np.uint64(mask) == 0
                    ok &= np.where(k < t, ~same, np.where(k == t, same, True))
                return ok

            for i in range(0, len(left), 1 << 20):
                a, b = left[i : i + (1 << 20)], right[i : i + (1 << 20)]
                ok = met(a, b, a)
                np.add.at(count, a[ok], 1)
                np.add.at(count, b[ok], 1)
            for g in large:
                n = np.arange(starts[g], starts[g + 1])
                for k, x in enumerate(n[:-1]):
                    rest = n[k + 1 :]
                    ok = met(np.full(len(rest), x), rest, rest)
                    count[x] += ok.sum()
                    count[rest[ok]] += 1
            some = count > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[n][some]) for n in names] + [pa.array(count[some])], [*names, "n"])

    return run


def neighbour_counts(fps: DataFrame, radius: int, words: int) -> DataFrame:
    """fps: distinct fingerprints in w0..; those that have others within the radius, with their number n."""
    per = (radius + 1) // words
    block_of = []
    for t in range(radius + 1):
        shift, width = segment_bounds(64, per)[t % per]
        block_of.append((t // per, shift, (1 << width) - 1))
    names = [f"w{i}" for i in range(words)]
    dealt = deal(block_tables(fps, radius, words), words).repartition(parts(fps.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub")
    schema = ", ".join(f"{n} long" for n in names) + ", n long"
    return dealt.select("cell", "sub", "table", "block", *names).mapInArrow(count_cells(radius, words, block_of), schema).groupBy(*names).agg(F.sum("n").alias("n"))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches; alternating large and small stars.

    Roots have no row of their own.  rows: about how many links there are, for the size of files.  The stars settle after
    a number of rounds that grows with the logarithm of the nodes; a round that changes nothing is the last.  Each round
    is cut by a checkpoint in the shared folder.  Roots are joined by shuffle; a node of very many links is
    split by the skew join, as both sides are plain equi-join inputs.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    mark = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (got["n"], got["s"]) == mark or not got["n"]:
            break
        mark = (got["n"], got["s"])
        # large star: each node's larger neighbours move to its smallest one
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours move to the smallest of them; a is the larger end of each link
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), got["n"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
