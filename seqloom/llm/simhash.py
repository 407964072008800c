"""SimHash: fingerprints by weighted votes, near duplicates by multi-index hashing.

Defined results: a null text is empty; a text without words has the fingerprint zero, linked like any other; repeated
rows each get a row, and a null doc_id never becomes a component's name unless all its rows have none; an empty table
gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import FIRST, LAST, Scratch, files_for, fresh, id_bounds, parts, ranges_for, slices, text_bytes, whole_text, written
from seqloom.llm.hamming import Forest, _groups, components, deal, links, neighbour_counts

# ---- shingle fingerprints and near duplicates -------------------------------------------------------------------


def shingles(text: str, k: int) -> list[bytes]:
    """k-word shingles of a text with A-Z lowered, repeats included; bytes.split() cuts at \\x20 and \\x09-\\x0D alone."""
    words = text.encode().lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return [whole[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)]


def shingle_fingerprint(text: str, k: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is one if it is set in over half of the shingles' XXH64."""
    grams, digest = shingles(text, k), xxhash.xxh64_intdigest
    if not grams:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(grams), 1 << 15):
        h = np.array([digest(g, seed) for g in grams[i : i + (1 << 15)]], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """id (as it was), w0: the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([shingle_fingerprint(t, k, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "w0"])

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {kind}, w0 long")


def near_components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """prints (id, w0), written or checkpointed: (w0, component) with the smallest id that the links reach from w0."""
    classes = prints.groupBy("w0").agg(F.min("id").alias("least"))
    edges = links(classes.select("w0"), radius)
    roots = written(components(edges), "roots")
    reach = classes.join(roots, classes["w0"] == roots["node"], "left").select("w0", F.coalesce("root", "w0").alias("root"), "least")
    names = reach.groupBy("root").agg(F.min("least").alias("component"))
    linked = reach.join(names, "root")
    return linked.select("w0", "component")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each document."""
    prints = written(fingerprints(docs, k=k), "prints")
    classes = written(near_components(prints, radius), "classes")
    return prints.join(classes, "w0").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# ---- weighted term fingerprints ---------------------------------------------------------------------------------

WORDS = 2  # of 64 bits
RADIUS = 3


class Terms:
    """Signs of the hashes of terms, kept for the terms met last; never more than ROOM of them."""

    ROOM, CHUNK = 1 << 16, 4096

    def __init__(self, bits: int = 64 * WORDS) -> None:
        self.bits, self.at = bits, {}
        self.signs = np.zeros((1024, bits), np.float32)

    def rows(self, terms: list[str]) -> np.ndarray:
        if len(self.at) + len(terms) > self.ROOM:
            self.at = {}
        new = [t for t in terms if t not in self.at]
        if new:
            first = len(self.at)
            while first + len(new) > len(self.signs):
                self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
            raw = b"".join(xxhash.xxh3_128_digest(t.encode(), 7) for t in new)
            self.signs[first : first + len(new)] = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 128)[:, : self.bits] * np.float32(2) - 1
            self.at.update(zip(new, range(first, first + len(new)), strict=False))
        return self.signs[[self.at[t] for t in terms]]

    def fingerprint(self, text: str) -> bytes:
        """Each term votes with the signs of its hash, weighted by its count (damped) and length (rare terms are long).

        Weights are whole numbers and a chunk's sums stay under 2^24, so equal texts get equal bits on any executor.
        """
        counts = Counter(terms(text))
        votes, items = np.zeros(self.bits), list(counts.items())
        for i in range(0, len(items), self.CHUNK):
            some = items[i : i + self.CHUNK]
            weight = np.array([round(8 * (1 + math.log(min(n, 1 << 30))) * math.log(1 + len(t))) for t, n in some], np.float32)
            votes += weight @ self.rows([t for t, _ in some])
        return np.packbits(votes > 0).tobytes()


def terms(text: str) -> Iterator[str]:
    """Lower-cased words; of one over 32 characters (no spaces, as in some scripts) its 4-grams."""
    for w in text.lower().split():
        if len(w) <= 32:
            yield w
        else:
            yield from (w[i : i + 4] for i in range(len(w) - 3))


def likeness(a: bytes, b: bytes) -> float:
    """Cosine that the share of differing bits stands for, no less than 0."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, math.cos(math.pi * differ / (8 * len(a))))


def _ranges(bounds: list[int], ids: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The range of each row in the order of id and name; an id that is several bounds fills the ranges between by names."""
    low, high = (np.searchsorted(bounds, ids, side=side).astype(np.int64) for side in ("left", "right"))
    share = (names.astype(np.float64) + 2.0**63) / 2.0**64
    return low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)


def _openings(docs: DataFrame, bounds: list[int]) -> dict[int, tuple[int, int]]:
    """For each non-empty range its first (id, name); an entry for each range."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for b in batches:
            ids, names = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = _ranges(bounds, ids, names)
            order = np.lexsort((names, ids, at))
            for k in order[np.r_[True, at[order][1:] != at[order][:-1]]] if len(order) else ():
                mine = int(ids[k]), int(names[k])
                least[int(at[k])] = min(least.get(int(at[k]), mine), mine)
        cols = list(least), [v[0] for v in least.values()], [v[1] for v in least.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bucket", "id", "name"])

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"), F.xxhash64(whole_text()).alias("name"))
    rows = src.mapInArrow(firsts, "bucket long, id long, name long").groupBy("bucket").agg(F.min(F.struct("id", "name")).alias("f")).collect()  # a row a range
    return {r["bucket"]: (r["f"]["id"], r["f"]["name"]) for r in rows}


def edited_prints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; see op3 in the README for the edit.

    Documents are dealt out in ranges of ids; the first of a range also goes to the range before it (the very first to
    the last), so that a text has its successor beside it after one shuffle.  Null ids come first; rows of one id are in
    the order of their texts' hashes, and fill several ranges if they are many.
    """
    count = ranges_for(text_bytes(docs))
    bounds = id_bounds(docs, count)
    first = _openings(docs, bounds)
    order = sorted(first)
    before = {first[k]: order[i - 1] for i, k in enumerate(order)}  # what opens a range -> the range before

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = np.array(sorted({k[0] for k in before}), np.int64)
        for b in batches:
            key, name = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = _ranges(bounds, key, name)
            also = np.array([k for k in np.flatnonzero(np.isin(key, opening)) if (int(key[k]), int(name[k])) in before], np.int64)
            take = np.r_[np.arange(len(key)), also]
            bucket = np.r_[at, np.array([before[int(key[k]), int(name[k])] for k in also], np.int64)]
            tail = np.r_[np.zeros(len(key), bool), np.ones(len(also), bool)]
            picked = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(tail), *picked.columns], ["bucket", "tail", "key", "name", "doc_id", "text"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, prev, out = Terms(), None, []

        def row(p, nxt, nxt_print):
            n = len(p[2])
            k = n // 4
            text = p[2][: n - k] + nxt[:k] if k else p[2]
            e = hasher.fingerprint(text) if k else p[3]
            return (p[1], n, hashlib.sha256(text.encode()).hexdigest(), p[3].hex(), e.hex(), likeness(p[3], e), likeness(p[3], nxt_print))

        def flush():
            rows = list(zip(*out, strict=False))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names)

        for b in batches:
            for bucket, tail, doc_id, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=False):
                if tail and (prev is None or prev[0] != bucket):
                    continue  # a second row of the id that opens the next range
                own = hasher.fingerprint(text)
                if prev is not None and prev[0] == bucket:
                    out.append(row(prev, text, own))
                prev = None if tail else (bucket, doc_id, text, own)
            if out:
                yield flush()

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("key"), F.xxhash64(whole_text()).alias("name"), F.col("doc_id").cast("long"), whole_text().alias("text"))
    dealt = src.mapInArrow(deal, "bucket long, tail boolean, key long, name long, doc_id long, text string")
    near = dealt.repartition(count, "bucket").sortWithinPartitions("bucket", "tail", "key", "name", "text")
    return near.mapInArrow(edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """edited_prints, and n_near: the number of other distinct fingerprints within the radius, by permuted block tables."""
    rows = written(edited_prints(docs), "fingerprints")
    word = lambda i: F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long")
    prints = rows.select("fingerprint").distinct().select("fingerprint", *[word(i).alias(f"w{i}") for i in range(WORDS)])
    names = [f"w{i}" for i in range(WORDS)]
    near = neighbour_counts(prints.select(*names), radius, WORDS)
    hexed = F.lower(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in names]))
    return rows.join(near.select(hexed.alias("fingerprint"), F.col("n")), "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("n", F.lit(0).cast("long")).alias("n_near")
    )


# ---- one document of each group -----------------------------------------------------------------------------------

#: Chance that two texts of just the similarity asked for meet in no band.
MISS = 1e-4


def bands_for(similarity: float, rows: int) -> int:
    """Bands of `rows` least hashes each that miss a pair at the similarity with a chance of MISS."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**rows))


def gram_hashes(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in shingles(text, k)], "<u8"))


def least_hashes(grams: np.ndarray, count: int) -> np.ndarray:
    """MinHash: the least value of each of `count` hashes; two sets agree in each with the chance of their Jaccard similarity."""
    rng = np.random.default_rng(5)
    mul, add = rng.integers(0, 1 << 63, (2, count), np.uint64)
    mul = mul * np.uint64(2) + np.uint64(1)
    out = np.full(count, (1 << 64) - 1, np.uint64)
    for i in range(0, len(grams), 1024):
        out = np.minimum(out, (grams[i : i + 1024, None] * mul + add).min(0))
    return out


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(least[i : i + rows].tobytes(), i) for i in range(0, len(least), rows)], np.uint64).view(np.int64)


def text_names(text: str = "text") -> list[Column]:
    """A text's name: two 64-bit hashes of other seeds."""
    return [F.xxhash64(whole_text(text)).alias("h0"), F.xxhash64(F.lit(1), whole_text(text)).alias("h1")]


def band_prints(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, h0, h1 (the text's name), print (its SimHash fingerprint), keys of the bands of its shingles' least hashes, sketch:
    those keys and 16 bits of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(3).to_pylist()
            prints = np.array([shingle_fingerprint(t) for t in texts], np.uint64).view(np.int64)
            least = [least_hashes(gram_hashes(t, k), bands * rows) for t in texts]
            made = [band_keys(x, rows) for x in least]
            keys = pa.array(made, pa.list_(pa.int64()))
            some = pa.array([x.tobytes() + y.astype("<u2").tobytes() for x, y in zip(made, least, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(prints), keys, some], ["id", "h0", "h1", "print", "keys", "sketch"])

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), *text_names(), whole_text().alias("text"))
    return src.mapInArrow(run, "id long, h0 long, h1 long, print long, keys array<long>, sketch binary")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """id, grams: sorted distinct shingle hashes of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            grams = [gram_hashes(t, k).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary())], ["id", "grams"])

    return texts.select("id", "text").mapInArrow(run, "id long, grams binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = [jaccard(x, y) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    first, second = sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _apart(bands: int, similarity: float, exact: bool):
    """The rows of a cell that have others of another root whose least hashes agree about as often as those of similar sets
    do and that meet in no earlier band (the first, 0, is that of near fingerprints); if exact, spanning links of the roots
    whose rows have similar sets."""
    names = ["cell", "sub", "w0", "root", "band", "near", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in _groups(batches, [*names, "grams"] if exact else names):
            root, band, forest = cols["root"], cols["band"].tolist(), Forest()
            raw = np.frombuffer(b"".join(cols["sketch"].tolist()), np.uint8).reshape(len(root), -1)
            keys, least = np.ascontiguousarray(raw[:, : 8 * bands]).view("<i8"), np.ascontiguousarray(raw[:, 8 * bands :]).view("<u2")
            keys = np.column_stack([cols["near"], keys])
            count = least.shape[1]
            enough = count * similarity - 5 * math.sqrt(count * similarity * (1 - similarity))  # five deviations under the mean
            some = np.zeros(len(root), bool)
            for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for i in range(at, end - 1):
                    others = i + 1 + np.flatnonzero(root[i + 1 : end] != root[i])
                    others = others[np.count_nonzero(least[others] == least[i], axis=1) >= enough]
                    others = others[~(keys[others, : band[i]] == keys[i, : band[i]]).any(1)]
                    if exact:
                        for j in others.tolist():
                            x, y = int(root[i]), int(root[j])
                            if forest.root(x) != forest.root(y) and jaccard(cols["grams"][i], cols["grams"][j]) >= similarity:
                                forest.join(x, y)
                    elif len(others):
                        some[i] = some[others] = True
            if exact:
                stars = forest.stars()
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in stars], pa.int64()), pa.array([p[1] for p in stars], pa.int64())], ["a", "b"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(cols[n][some]) for n in names[:-1]] + [pa.array(cols["sketch"][some], pa.binary())], names)

    return run


def one_of_each(docs: DataFrame, k: int, rows: int, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """docs without near duplicates, with all their columns.

    Of equal texts the smallest doc_id stays.  Candidates are the texts of one component of SimHash fingerprints within the
    radius, as near_duplicates makes them (multi-index hashing), and, as such fingerprints miss many texts that have the
    similarity, those that agree in a band of `rows` least hashes of their k-word shingles.  Candidates whose sets of
    shingles have the similarity are linked, and the smallest id of each component of links stays.  A component of
    fingerprints and a band's key are cells alike: first the texts of a cell are compared with one of them, then all in a
    cell that no links join yet with each other.  Everything goes by texts, not by ids: rows of one id and other texts are
    judged apart.  Rows of one id and text count as one; a null id comes after all others.
    """
    count = docs.count()
    files, bands, scratch = files_for(count), bands_for(similarity, rows), Scratch(docs.sparkSession)
    keep = lambda df, name: scratch(df, name, files)
    prints = keep(band_prints(docs, k, bands, rows), "prints")
    near = keep(components(links(prints.select(F.col("print").alias("w0")).distinct(), radius), count), "near").toDF("print", "near")
    distinct = prints.groupBy("h0", "h1").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("print", "keys", "sketch")])
    placed = distinct.join(near, "print", "left").select("h0", "h1", "id", F.coalesce("near", "print").alias("near"), "keys", "sketch")
    texts = keep(placed.withColumn("node", F.monotonically_increasing_id()), "texts")
    filed = texts.select("node", F.posexplode(F.concat(F.array(F.xxhash64(F.lit("near"), "near")), "keys")).alias("band", "cell"))
    cells = filed.groupBy("cell").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    met = keep(filed.join(cells, "cell").select("cell", "band", "n", "a", "node"), "met")
    stars = keep(met.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "stars")
    name = ["id", "h0", "h1"]
    wanted = texts.join(met.select("node").distinct(), "node").select("node", *name)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), *text_names(), whole_text().alias("text"))
    own = src.join(wanted, name).select(F.col("node").alias("id"), "text")
    sets = keep(shingle_sets(own, k).groupBy("id").agg(F.min("grams").alias("grams")), "sets")
    linked = keep(alike(stars, sets, similarity), "linked")
    roots = met.filter("n > 2").select("cell", "band", F.col("node").alias("w0")).join(components(linked, count), F.col("w0") == F.col("node"), "left")
    roots = keep(roots.select("cell", "band", "w0", F.coalesce("root", "w0").alias("root")), "roots")
    mixed = roots.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("cell")
    some = keep(roots.join(mixed, "cell").join(texts.select(F.col("node").alias("w0"), "near", "sketch"), "w0").select("cell", "band", "w0", "root", "near", "sketch"), "mixed")
    group = lambda df: df.repartition(parts(docs.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub", "w0")
    names = ["cell", "sub", "w0", "root", "band", "near", "sketch"]
    apart = group(deal(some, 1)).select(*names).mapInArrow(_apart(bands, similarity, False), "cell long, sub long, w0 long, root long, band int, near long, sketch binary")
    apart = keep(apart, "apart").join(sets, F.col("w0") == F.col("id")).select(*names, "grams")
    rest = keep(group(apart).mapInArrow(_apart(bands, similarity, True), "a long, b long"), "rest")
    tied = keep(components(linked.union(rest), count), "tied")
    tied = tied.union(tied.select("root", "root").distinct())
    members = keep(texts.join(tied, "node").select("root", "node", *name), "members")
    least = members.groupBy("root").agg(F.min(F.struct(*name)).alias("least"))
    gone = members.join(least, "root").filter(F.struct(*name) != F.col("least")).select("node")
    kept = written(texts.join(gone, "node", "left_anti").select(*name), "kept", files=files)
    again = prints.groupBy(*name).count().filter("count > 1").limit(1).count()
    scratch.clear()
    marks = fresh(docs.columns, *name)
    marked = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias(marks[0]), *[c.alias(m) for c, m in zip(text_names(), marks[1:], strict=True)])
    out = marked.join(kept.toDF(*marks), marks, "left_semi")
    return (out.dropDuplicates(marks) if again else out).select(*[F.col(f"`{c}`") for c in docs.columns])
