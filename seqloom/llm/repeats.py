"""Exact substring dedup: every byte under a WINDOW-byte string that starts anywhere else too.

The construction is column-wise over many documents at once: a collection of strings is sorted by adding one symbol of
each string a round, and with the order the array of common lengths with the neighbour is kept.  Two strings of one
round that stand side by side with a common length of WINDOW or more end in the same WINDOW bytes.  To keep every
collection small and every round in step, strings are cut and aligned first:

1. Every window names its anchor, the place of the least hash among its ANCHOR-byte strings.  Equal windows name equal
   anchors at equal distances, so only windows of one anchor hash can be equal, and they are equal column by column when
   aligned at the anchor.  Windows in a row with one anchor make a piece (at most WINDOW + their number - 1 bytes).
2. Pieces whose key no other piece has hold no repeat.  Pieces that are equal as a whole repeat in all their windows.
   Of the rest one copy of each distinct piece is compared.
3. Distinct pieces, dealt out by key and aligned at their anchors, go through the rounds.
4. A key with more than PIECES distinct pieces is cut: each piece into halves by windows, with the hash of the bytes
   that all windows of the half share as its key, and again from 2.  A piece of one window is its own key.

Nothing meets in one task but the distinct pieces of keys of bounded size; copies are counted, never gathered.

Beside the bytes removed, passages are reported: runs of PASSAGE words and more, whatever their bytes, that another
document holds too, word by word.  They go the same way in units of words (pieces by anchor, equal pieces, then the
windows of the rest), and take nothing out.

Defined results: a null text is empty; texts shorter than WINDOW lose nothing; rows are documents of their own, whatever
their ids, so equal rows of WINDOW bytes or more lose all; an empty table gives an empty result; other columns are unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, parts, whole_text, written

WINDOW, ANCHOR = 400, 128
PASSAGE, PASSAGE_ANCHOR = 50, 16
PIECES, TOGETHER = 1024, 8192
SEGMENT = 1 << 19  # windows looked at together; a place fits the low 20 bits
_PLACE = np.uint64((1 << 20) - 1)


# ---- anchors and pieces -----------------------------------------------------------------------------------------


def _odd_inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


_MULT = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Hashes of strings of a buffer of symbols, by differences of prefix sums modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            for name, factor in (("up", _MULT), ("down", _odd_inverse(_MULT))):
                powers = np.full(n + 1, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return sums

    def of(self, data: np.ndarray, size: int) -> np.ndarray:
        """Of all strings of a size."""
        sums = self._sums(data)
        return _mixed((sums[size:] - sums[:-size]) * self.down[: len(data) - size + 1])

    def spans(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the strings from begins to ends."""
        sums = self._sums(data)
        return _mixed((sums[ends] - sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64))


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every `size` values in a row, from running minima of blocks to both sides."""
    n = len(x)
    whole = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    whole[:n] = x
    rows = whole.reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], ahead[size - 1 : n])


def pieces(data: np.ndarray, starts: np.ndarray, hashes: Hashes, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """data: the symbols of texts one after another, text k from starts[k] to starts[k + 1].

    (key, first, count, place): a piece's anchor hash, first window, number of windows and anchor place in data.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none.view(np.uint64), none, none, none
    h = hashes.of(data, anchor)
    marked = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_least(marked, window - anchor + 1) & _PLACE).astype(np.int64)
    inside = np.ones(len(place), bool)
    for s in starts[1:-1]:  # windows that run into the next text
        inside[max(0, s - window + 1) : s] = False
    w = np.flatnonzero(inside)
    if not len(w):
        return none.view(np.uint64), none, none, none
    p = place[w]
    new = np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1)]
    at = np.flatnonzero(new)
    return h[p[at]], w[at], np.diff(np.r_[at, len(w)]), p[at]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes other than \\x20 and \\x09-\\x0D."""
    edge = np.diff(np.r_[False, (data != 32) & ((data < 9) | (data > 13)), False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _segments(rows: Iterator[tuple[int, bytes]], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) lists of about SEGMENT bytes; a longer text is cut with an overlap of window - 1 bytes."""
    now, size = [], 0
    for row, text in rows:
        for offset in range(0, max(1, len(text) - window + 1), SEGMENT):
            some = text[offset : offset + SEGMENT + window - 1]
            if len(some) >= window:
                if size + len(some) > SEGMENT + window:
                    yield now
                    now, size = [], 0
                now.append((row, offset, some))
                size += len(some)
    if now:
        yield now


PIECE = "key long, f0 long, f1 long, row long, start long, count int, lead int"


def _piece_batch(key, digests, row, start, count, lead, raw=None, kind=None) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    cols = [pa.array(np.asarray(key, np.int64)), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(np.asarray(row, np.int64)), pa.array(np.asarray(start, np.int64)), pa.array(np.asarray(count, np.int32)), pa.array(np.asarray(lead, np.int32))]
    names = ["key", "f0", "f1", "row", "start", "count", "lead"]
    more = {"raw": raw and pa.array(raw, pa.binary()), "kind": kind is not None and pa.array([kind] * len(row), pa.int32())}
    return pa.RecordBatch.from_arrays(cols + [v for v in more.values() if v], names + [k for k, v in more.items() if v])


BYTES, WORDS = 0, 1


def passage_pieces(rows: list[tuple[int, bytes]], hashes: Hashes, words: int) -> pa.RecordBatch | None:
    """Pieces of whole texts in units of words; f0, f1: hash of the hashes of a piece's windows."""
    found, starts, window = [], [0], []
    for _, text in rows:
        data = np.frombuffer(text, np.uint8)
        found.append(hashes.spans(data, *word_bounds(data)))
        starts.append(starts[-1] + len(found[-1]))
    data, starts = np.concatenate(found), np.array(starts)
    key, first, count, place = pieces(data, starts, hashes, words, min(PASSAGE_ANCHOR, words))
    if not len(key):
        return None
    window = hashes.of(data, words)
    of = np.searchsorted(starts, first, side="right") - 1
    digests = [xxhash.xxh3_128_digest(window[a:b]) for a, b in zip(first.tolist(), (first + count).tolist(), strict=True)]
    return _piece_batch(key.view(np.int64), digests, np.array([r for r, _ in rows], np.int64)[of], first - starts[of], count, place - first, kind=WORDS)


def piece_table(texts: DataFrame, window: int, anchor: int, words: int = PASSAGE) -> DataFrame:
    """Pieces of texts (row, text): key, f0, f1 (hash of the bytes), row, start, count, lead (anchor place less start), kind.

    Pieces of kind BYTES count bytes, those of kind WORDS words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, digest, waiting, out = Hashes(), xxhash.xxh3_128_digest, [], []

        def seen(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
            """The rows, which also go to passage_pieces, some whole texts at a time."""
            size = 0
            for row, text in rows:
                if waiting and size + len(text) > SEGMENT:
                    passages()
                    size = 0
                waiting.append((row, text))
                size += len(text)
                yield row, text

        def passages() -> None:
            if waiting and (got := passage_pieces(waiting, hashes, words)) is not None:
                out.append(got)
            waiting.clear()

        rows = ((r, t.encode()) for b in batches for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for some in _segments(seen(rows), window):
            buffer = b"".join(s[2] for s in some)
            starts = np.cumsum([0, *[len(s[2]) for s in some]])
            key, first, count, place = pieces(np.frombuffer(buffer, np.uint8), starts, hashes, window, anchor)
            if len(key):
                of = np.searchsorted(starts, first, side="right") - 1
                row, offset = np.array([s[0] for s in some], np.int64)[of], np.array([s[1] for s in some], np.int64)[of]
                ends = (first + count + window - 1).tolist()
                digests = [digest(buffer[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
                yield _piece_batch(key.view(np.int64), digests, row, offset + first - starts[of], count, place - first, kind=BYTES)
            yield from out
            out.clear()
        passages()
        yield from out

    return texts.mapInArrow(run, PIECE + ", kind int")


# ---- rounds -----------------------------------------------------------------------------------------------------


def repeated_ends(strings: list[bytes], leads: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string the starts (in it) of its windows that another string has at the same distance from its anchor.

    Round c adds the symbol in column c of every string.  order holds the strings sorted by what the rounds so far have
    read, last symbol first; common[k] is how many last symbols string order[k] shares with the one before it.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings])
    left = int(leads.max())
    begin = left - leads
    width = int((begin + sizes).max())
    grid = np.zeros((width, m), np.uint16)  # 0: nothing there
    for i, s in enumerate(strings):
        grid[begin[i] : begin[i] + sizes[i], i] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    order, common = np.arange(m), np.zeros(m + 1, np.int64)
    repeated = np.zeros((width, m), bool)
    for c in range(width):
        symbol = grid[c][order]
        turn = np.argsort(symbol, kind="stable")
        same = np.zeros(m, bool)
        sorted_symbols = symbol[turn]
        same[1:] = sorted_symbols[1:] == sorted_symbols[:-1]
        now = np.zeros(m + 1, np.int64)
        k = np.flatnonzero(same)
        if len(k):
            # the least common length on the way from one to the next of its symbol, and the symbol itself
            spans = np.empty(2 * len(k), np.int64)
            spans[::2], spans[1::2] = turn[k - 1] + 1, turn[k] + 1
            now[k] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[turn], now
        if c >= window - 1:
            long = common >= window
            hit = order[long[:-1] | long[1:]]
            if len(hit):
                repeated[c, hit] = True
    out = []
    for i in range(m):
        ends = np.flatnonzero(repeated[begin[i] + window - 1 : begin[i] + sizes[i], i])
        out.append(ends)
    return out


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of runs of neighbours in sorted numbers."""
    if not len(x):
        return []
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1] + 1])
    return list(zip(x[at].tolist(), np.diff(np.r_[at, len(x)]).tolist(), strict=True))


def solve(window: int):
    """Rows sorted by key (row, start, lead, single, raw): (row, first, count) of the single pieces' repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rounds(held: list[tuple]) -> pa.RecordBatch | None:
            ends = repeated_ends([h[5] for h in held], np.array([h[3] for h in held]), window)
            out = [(h[1], h[2] + a, n) for h, e in zip(held, ends, strict=True) if h[4] for a, n in _runs(e)]
            if out:
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "first", "count"])

        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= TOGETHER and r[0] != held[-1][0]:
                    if got := rounds(held):
                        yield got
                    held = []
                held.append(r)
        if held and (got := rounds(held)):
            yield got

    return run


def halve(window: int, step: int):
    """Pieces (row, start, count, lead, raw) cut at multiples of step windows before the anchor.

    The key of a part is the hash of the bytes that all windows of its cell share; a piece with one window of a cell
    holds them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, start, count, lead, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                low, high = lead - count + 1, lead  # distances of the last and the first window from the anchor
                for a in range(low // step * step, high + 1, step):
                    z = a + step
                    near, far = max(a, low), min(z - 1, high)
                    i = lead - far  # the part's first window, in the piece
                    n = far - near + 1
                    part = raw[i : i + n + window - 1]
                    core = raw[lead - a : lead - z + 1 + window]
                    key = xxhash.xxh3_64_intdigest(core + a.to_bytes(8, "little", signed=True) + z.to_bytes(8, "little", signed=True), 1)
                    out.append((np.uint64(key).view(np.int64), xxhash.xxh3_128_digest(part), row, start + i, n, lead - i, part))
            if out:
                yield _piece_batch(*zip(*out, strict=True))

    return run


# ---- levels -----------------------------------------------------------------------------------------------------


def _spread(pieces: DataFrame) -> DataFrame:
    """Pieces that a join by key has put together, dealt out evenly again: the copies of one piece then lie in all files, and
    a later join by piece can be split."""
    return pieces.repartition(parts(pieces.sparkSession), F.xxhash64("row", "start"))


ASKED = ["kind", "key", "c", "single", "row", "start", "count", "lead"]


def _level(table: DataFrame, window: int, raw_of, step: int, keep) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """table: written pieces.  (row, first, count) of repeated windows found, the halves of pieces of oversized keys, and
    the pieces that were looked at."""
    # written before they are joined: a join of two plain tables can split a key with very many rows
    many = keep(table.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    shared = keep(_spread(table.drop("raw", "kind").join(many, "key", "left_semi")), "shared")
    classes = keep(shared.groupBy("key", "f0", "f1").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "count", "lead")).alias("r")), "classes")
    # equal pieces: all their windows
    copies = shared.join(classes.filter("n > 1").select("key", "f0", "f1"), ["key", "f0", "f1"], "left_semi")
    found = copies.select("row", F.col("start").alias("first"), F.col("count").cast("long").alias("count"))
    # keys with several distinct pieces, one of them single
    keys = classes.groupBy("key").agg(F.count("*").alias("c"), F.sum((F.col("n") == 1).cast("long")).alias("singles")).filter("c > 1 AND singles > 0")
    left = classes.join(keep(keys.select("key", "c"), "several"), "key").select(F.lit(BYTES).alias("kind"), "key", "c", (F.col("n") == 1).alias("single"), "r.row", "r.start", "r.count", "r.lead")
    both = keep(raw_of(left), "compared")
    left = both.filter(F.col("kind") == BYTES)
    dealt = left.filter(F.col("c") <= PIECES).repartition(parts(table.sparkSession), "key").sortWithinPartitions("key")
    rounds = dealt.select("key", "row", "start", "lead", "single", "raw").mapInArrow(solve(window), "row long, first long, count long")
    found = found.union(rounds)
    hot = left.filter(F.col("c") > PIECES)
    if hot.limit(1).count() == 0:
        return found, None, both
    return found, keep(hot.select("row", "start", "count", "lead", "raw").mapInArrow(halve(window, step), PIECE + ", raw binary"), "halves"), both


def _asked_passages(table: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """table: written pieces in words.  (row, first, count) of the windows of equal pieces of several documents, and the
    pieces whose windows are to be compared, as ASKED: those of one document, and one of each that several have."""
    several = F.min("row") != F.max("row")
    many = keep(table.groupBy("key").agg(several.alias("several")).filter("several").select("key"), "passage-keys")
    shared = keep(_spread(table.join(many, "key", "left_semi")), "passage-shared")
    classes = keep(shared.groupBy("key", "f0", "f1").agg(several.alias("several"), F.min(F.struct("row", "start", "count")).alias("r")), "passage-classes")
    member = shared.join(classes.select("key", "f0", "f1", "several"), ["key", "f0", "f1"])
    found = member.filter("several").select("row", F.col("start").alias("first"), F.col("count").cast("long").alias("count"))
    keys = classes.groupBy("key").agg(F.min("several").alias("all")).filter("NOT all").select("key")
    asked = F.lit(WORDS).alias("kind"), "key", F.lit(0).cast("long").alias("c")
    some = member.filter("NOT several").select(*asked, F.lit(True).alias("single"), "row", "start", "count", F.lit(0).alias("lead"))
    one = classes.filter("several").join(keys, "key", "left_semi").select(*asked, F.lit(False).alias("single"), "r.row", "r.start", "r.count", F.lit(0).alias("lead"))
    return found, some.union(one)


def _met_passages(both: DataFrame, keep) -> DataFrame:
    """(row, first, count) of the windows of single pieces that another document has; raw: their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(x, "<i8") for x in b.column(4).to_pylist()]
            if not raw:
                continue
            n = [len(x) for x in raw]
            first = np.concatenate([np.arange(s, s + k) for s, k in zip(b.column(3).to_pylist(), n, strict=True)])
            cols = [np.repeat(b.column(i).to_numpy(zero_copy_only=False), n) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(first), pa.array(np.concatenate(raw))], ["key", "single", "row", "first", "hash"])

    schema = "key long, single boolean, row long, first long, hash long"
    windows = keep(both.filter(F.col("kind") == WORDS).select("key", "single", "row", "start", "raw").mapInArrow(run, schema), "passage-windows")
    met = windows.groupBy("key", "hash").agg(((F.min("row") != F.max("row")) | ~F.min("single")).alias("met")).filter("met").select("key", "hash")
    return windows.filter("single").join(met, ["key", "hash"], "left_semi").select("row", "first", F.lit(1).cast("long").alias("count"))


def _packed(texts: DataFrame) -> DataFrame:
    """(row, packed): texts for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], ["row", "packed"])

    return texts.mapInArrow(run, "row long, packed binary")


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _window_hashes(text: bytes, hashes: Hashes, words: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return hashes.of(hashes.spans(data, *word_bounds(data)), words).view(np.int64)


def repeated_windows(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, words: int = PASSAGE) -> list[DataFrame]:
    """(kind, row, first, count) of all windows of texts (row, text; rows distinct) that start anywhere else too (BYTES) or
    that another text holds (WORDS)."""
    step = 1 << (window - anchor).bit_length() - 1
    keep = Scratch(texts.sparkSession)
    both = keep(piece_table(texts, window, anchor, words), "pieces")
    table = both.filter(F.col("kind") == BYTES)
    equal, asked_words = _asked_passages(both.filter(F.col("kind") == WORDS).drop("kind", "lead"), keep)

    def from_texts(left: DataFrame) -> DataFrame:
        asked = left.select(*ASKED).union(asked_words.select(*ASKED)).groupBy("row").agg(F.collect_list(F.struct(*[c for c in ASKED if c != "row"])).alias("asked"))

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for b in batches:
                for row, packed, some in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    text = _unpack(packed)
                    own = _window_hashes(text, hashes, words) if any(g["kind"] == WORDS for g in some) else None
                    for i in range(0, len(some), 4096):
                        got = some[i : i + 4096]
                        cols = {k: [g[k] for g in got] for k in ASKED if k != "row"}
                        raw = [text[g["start"] : g["start"] + g["count"] + window - 1] if g["kind"] == BYTES else own[g["start"] : g["start"] + g["count"]].tobytes() for g in got]
                        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                        arrays = [pa.array(cols.get(k, [row] * len(got)), t) for k, t in zip(ASKED, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([*arrays, pa.array(raw, pa.binary())], [*ASKED, "raw"])

        schema = "kind int, key long, c long, single boolean, row long, start long, count int, lead int, raw binary"
        return _packed(texts).join(asked, "row").mapInArrow(take, schema)

    found, halves, looked = _level(table, window, from_texts, step, keep)
    out = [written(found.withColumn("kind", F.lit(BYTES)), "found"), written(equal.union(_met_passages(looked, keep)).withColumn("kind", F.lit(WORDS)), "passages")]
    while halves is not None:
        table, step = halves, step // 2
        found, halves, _ = _level(table, window, lambda left, table=table: left.join(table.select("row", "start", "raw"), ["row", "start"]), step, keep)
        out.append(written(found.withColumn("kind", F.lit(BYTES)), "found"))
    keep.clear()
    return out


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of (begin, end) spans; spans that touch make one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, words: int = PASSAGE, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes (and the kept bytes as text, decoded with
    replacement).

    n_passages, passage_bytes: maximal runs of `words` words and more that another document holds too, and their bytes.
    """
    count = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if count["n"] == count["d"]:
        texts = docs.select(F.col("doc_id").cast("long").alias("row"), whole_text().alias("text"))
        names = None
    else:  # ids that are null or occur again do not tell rows apart
        rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), whole_text().alias("text")), "rows")
        texts, names = rows.select("row", "text"), rows.select("row", "doc_id")
    found = repeated_windows(texts, window, anchor, words)
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("kind", "first", "count")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, packed, some in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, at, kept = _unpack(packed), 0, []
                gone = _cover([(s["first"], s["first"] + s["count"] + window - 1) for s in some or () if s["kind"] == BYTES])
                for a, z in gone:
                    kept.append(text[at:a])
                    at = z
                kept.append(text[at:])
                rest = b"".join(kept)
                # a run of words that meets the next at a word's end is another run
                runs = _cover([(2 * s["first"], 2 * (s["first"] + s["count"] + words - 1) - 1) for s in some or () if s["kind"] == WORDS])
                size = 0
                if runs:
                    begins, ends = word_bounds(np.frombuffer(text, np.uint8))
                    size = sum(int(ends[(z - 1) // 2] - begins[a // 2]) for a, z in runs)
                out.append((row, len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), len(runs), size, rest.decode(errors="replace") if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "text"])

    schema = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, text string"
    done = _packed(texts).join(spans, "row", "left").mapInArrow(cut, schema)
    done = done.withColumnRenamed("row", "doc_id") if names is None else done.join(names, "row").drop("row")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]
    return done.select(*cols, "text") if with_text else done.select(*cols)
