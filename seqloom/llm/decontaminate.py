"""Benchmark decontamination: windows within a small edit distance of a benchmark item.

Texts and items are lower-cased and their white space is made single spaces.  Windows are embedded by the CGK random
walk (Chakraborty, Goldenberg, Koucky, 2016): one pointer goes through the string, each step copies the symbol under it
and a random bit of step and symbol says whether it moves on, so that few edits change few of the copies.

An item-sized window that begins s symbols into an item's copy embeds, to its first steps, like the item from symbol s
on.  So a walk of a few steps from every STRIDE-th symbol of a text is the beginning of an item-sized window's embedding
whatever the item's length, and every symbol of an item begins an entry of the tables.  A table's key is a sample of the
copies; WALKS walks with REPEATS samples each reach the target recall (measured in tests/llm).  A window that meets an
entry names an item and a place in the text; those places, each of an item's size and more by the edits allowed, are
verified, first by shared 3-grams (an edit spoils three at most, so nothing within the limit is lost), then by exact
edit distance.

Defined results: null and empty texts or items match nothing; an item matches wherever it stands, inside words too; an
item or document that occurs twice gives its rows twice over; an empty table on either side gives an empty result;
columns beside ids and texts are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.kernels import infix_distances
from seqloom.llm.common import slices, whole_text

SHARE = 0.1  # edits allowed, of an item's length
WALKS, REPEATS = 3, 4
#: (items of at least so many symbols, steps of a walk, copies in a key, symbols from window to window).  No walk passes
#: the end of an item; items under ten symbols allow no edit and have classes of their own lengths.
CLASSES = ((80, 40, 20, 8), (40, 24, 14, 2), (20, 16, 10, 1), (10, 10, 6, 1), *((n, n, n, 1) for n in range(9, 0, -1)))
#: Items broadcast and indexed at once (about 250 bytes a symbol in a worker); more are taken in blocks of so many
#: symbols (or one item), one pass over the documents each.
BLOCK_CHARS = 500_000
#: Symbols of texts looked at together.
TOGETHER = 1 << 21
GRAM = 3


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    """A byte from 1 on for each symbol; 0 is left for the ends of texts."""
    try:
        raw = np.frombuffer(text.encode("latin-1"), np.uint8).astype(np.uint16)
    except UnicodeEncodeError:
        raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return (raw % 255 + 1).astype(np.uint8)


def walk(buffer: np.ndarray, places: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK copies, a row for each step, of the strings that begin at places; the buffer goes on for `steps` symbols."""
    moves = np.random.default_rng(seed).integers(0, 2, (steps, 256), np.uint8).astype(np.int32)
    out, at = np.empty((steps, len(places)), np.uint8), places.astype(np.int32)
    for j in range(steps):
        c = buffer[at]
        out[j] = c
        at += moves[j][c]
    return out


def sampled_keys(copies: np.ndarray, sample: np.ndarray, factors: np.ndarray) -> np.ndarray:
    h = np.zeros(copies.shape[1], np.uint64)
    for j in sample:
        h += copies[j] * factors[j]
        h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def gram_codes(buffer: np.ndarray) -> np.ndarray:
    """A 16-bit hash of the symbols from each place on."""
    wide = buffer.astype(np.uint32)
    h = np.zeros(max(0, len(wide) - GRAM + 1), np.uint32)
    for g in range(GRAM):
        h = h * np.uint32(0x01000193) + wide[g : len(wide) - GRAM + 1 + g] * np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.uint16)


class Tables:
    """Bit-sampling tables over the items of one length class."""

    def __init__(self, items: list[np.ndarray], which: np.ndarray, steps: int, sampled: int, stride: int, repeats: int) -> None:
        self.steps, self.stride = steps, stride
        lengths = np.array([len(items[k]) for k in which])
        starts = np.r_[0, np.cumsum(lengths)]
        buffer = np.concatenate([*[items[k] for k in which], np.zeros(steps + 1, np.uint8)])
        entries = lengths - steps + 1
        self.item = np.repeat(which, entries).astype(np.int32)
        first = np.repeat(np.cumsum(entries) - entries, entries)
        self.offset = (np.arange(len(self.item)) - first).astype(np.int32)
        places = np.repeat(starts[:-1], entries) + self.offset
        rng = np.random.default_rng(steps)
        self.factors = rng.integers(1, 1 << 63, steps, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = np.uint64(64 - max(16, len(places).bit_length() + 3))
        self.walks: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        for w in range(WALKS):
            copies, tables = walk(buffer, places, steps, w), []
            for _ in range(repeats):
                sample = np.sort(rng.choice(steps, sampled, replace=False))
                keys = sampled_keys(copies, sample, self.factors)
                order = np.argsort(keys, kind="stable").astype(np.int32)
                there = np.zeros(1 << 64 - int(self.shift), bool)
                there[(keys >> self.shift).astype(np.int64)] = True
                tables.append((sample, there, keys[order], order))
            self.walks.append(tables)

    def hits(self, buffer: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, start of its window in the buffer; may lie before it) for windows that meet an entry, some more than once."""
        for first in range(0, max(0, len(buffer) - self.steps), self.stride << 18):
            places = np.arange(first, min(len(buffer) - self.steps, first + (self.stride << 18)), self.stride)
            for w, tables in enumerate(self.walks):
                copies = walk(buffer, places, self.steps, w)
                for sample, there, known, order in tables:
                    keys = sampled_keys(copies, sample, self.factors)
                    maybe = np.flatnonzero(there[(keys >> self.shift).astype(np.int64)])
                    low = np.searchsorted(known, keys[maybe])
                    count = np.searchsorted(known, keys[maybe], side="right") - low
                    at = 0
                    while at < len(maybe):  # a key of many entries is taken in turns
                        end = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), most)) + at)
                        n = count[at:end]
                        entry = order[np.repeat(low[at:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                        yield self.item[entry], np.repeat(places[maybe[at:end]], n) - self.offset[entry]
                        at = end


class Index:
    """Tables over a block of items (id, text)."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, repeats: int = REPEATS) -> None:
        self.share = share
        self.items = [(i, t) for i, t in ((i, normal(t or "")) for i, t in items) if t]
        symbols = [codes(t) for _, t in self.items]
        self.lengths = np.array([len(t) for t in symbols])
        self.grams = [np.unique(gram_codes(t)) for t in symbols]
        by_class = defaultdict(list)
        for k, n in enumerate(self.lengths.tolist()):
            by_class[next(c for c in CLASSES if n >= c[0])].append(k)
        self.tables = [Tables(symbols, np.array(ks), *c[1:], repeats) for c, ks in by_class.items()]

    def _places(self, buffer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts) of the windows that meet the item in a table and hold enough of its 3-grams."""
        held = defaultdict(list)
        for tables in self.tables:
            for item, start in tables.hits(buffer):
                both = np.unique((item.astype(np.int64) << 40) | (start.astype(np.int64) + (1 << 39)))
                cuts = np.flatnonzero(np.r_[True, both[1:] >> 40 != both[:-1] >> 40, True]) if len(both) else []
                for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                    held[int(both[at] >> 40)].append((both[at:end] & ((1 << 40) - 1)) - (1 << 39))
        grams = None
        for k in sorted(held):
            n = int(self.lengths[k])
            most = int(self.share * n)
            starts = np.unique(np.concatenate(held[k]))
            need = n - GRAM + 1 - GRAM * most
            if need > 0:
                grams = gram_codes(buffer) if grams is None else grams
                own = np.zeros(1 << 16, bool)
                own[self.grams[k]] = True
                a, z = np.clip(starts - 2 * most, 0, len(grams)), np.clip(starts + n + 2 * most, 0, len(grams))
                keep = np.zeros(len(starts), bool)
                width = int((z - a).max())
                step = max(1, (1 << 22) // max(1, width))
                for i in range(0, len(starts), step):
                    span = a[i : i + step, None] + np.arange(width)
                    inside = own[grams[np.minimum(span, len(grams) - 1)]] & (span < z[i : i + step, None])
                    keep[i : i + step] = inside.sum(1) >= need
                starts = starts[keep]
            if len(starts):
                yield k, starts

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, distance, start, end) of the best match of each item that a text holds; places in the normal text."""
        now, size = [], 0
        for d, text in enumerate(texts):
            whole = normal(text)
            if whole:
                if now and size + len(whole) > TOGETHER:
                    yield from self._together(now)
                    now, size = [], 0
                now.append((d, whole))
                size += len(whole)
        if now:
            yield from self._together(now)

    def _together(self, texts: list[tuple[int, str]]) -> Iterator[tuple[int, int, int, int, int]]:
        buffer = codes("\0".join(t for _, t in texts) + "\0" * 64)
        begins = np.cumsum([0, *[len(t) + 1 for _, t in texts]])
        buffer[begins[1:] - 1] = 0
        buffer[begins[-1] :] = 0
        found = []
        for k, starts in self._places(buffer):
            # the text in which most of the window lies, and its neighbours if the window reaches into them
            n = int(self.lengths[k])
            most = int(self.share * n)
            first = np.searchsorted(begins, np.maximum(starts - most, 0), side="right") - 1
            last = np.searchsorted(begins, np.maximum(starts + n + most, 0), side="right") - 1
            for x in range(int((last - first).max()) + 1):
                of = first + x
                ok = (of <= last) & (of < len(texts))
                for t in np.unique(of[ok]).tolist():
                    d, whole = texts[t]
                    best = self._verify(whole, self.items[k][1], starts[ok & (of == t)] - begins[t])
                    if best:
                        found.append((d, k, best))
        for d, k, best in sorted(found):
            yield d, self.items[k][0], *best

    def _verify(self, text: str, item: str, starts: np.ndarray) -> tuple[int, int, int] | None:
        at = text.find(item)
        if at >= 0:
            return 0, at, at + len(item)
        most, best, done = int(self.share * len(item)), None, None
        if not most or len(text) < len(item) - most:
            return None
        for start in starts.tolist():
            if done is not None and start <= done:
                continue
            done = start + most  # the span looked at reaches that far on both sides
            a, b = max(0, start - 2 * most), max(0, start + len(item) + 3 * most)
            scores = infix_distances(text[a:b], item)
            if scores and (d := min(scores)) <= most and (best is None or d < best[0]):
                end = a + scores.index(d) + 1
                back = infix_distances(text[a:end][::-1], item[::-1])
                best = d, end - back.index(min(back)) - 1, end
        return best


_INDEXES: dict[tuple, Index] = {}


def index_of(block: list[tuple[int, str]], share: float, repeats: int) -> Index:
    """The block's index; one for each worker process, which serves many tasks."""
    name = hashlib.sha256(repr((block, share, repeats)).encode()).digest()
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(block, share, repeats)
    return _INDEXES[name]


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Lists of items of at most `most` characters (or one item); toLocalIterator holds a partition at a time."""
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len(r["t"] or "")
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, share: float = SHARE, repeats: int = REPEATS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end: each item that a document holds, at its best place."""
    spark, found = docs.sparkSession, None
    src = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    schema = "doc_id long, item_id long, distance int, match_start long, match_end long"
    names = ["doc_id", "item_id", "distance", "match_start", "match_end"]
    for block in item_blocks(items, "item_id", "text", block_chars):
        shared = spark.sparkContext.broadcast(block)  # block_chars at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value, share, repeats)
            for b in slices(batches):
                ids = b.column(0).to_pylist()
                rows = [(ids[d], *rest) for d, *rest in index.search(b.column(1).to_pylist())]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names)

        part = src.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, repeats: int = REPEATS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    out, at = docs, docs.columns.index("text")
    for block in item_blocks(items, "item_id", "text", block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value, share, repeats)
            for b in slices(batches):
                held = {d for d, *_ in index.search([t or "" for t in b.column(at).to_pylist()])}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
