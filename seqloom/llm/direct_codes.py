"""Token ids in directly addressable codes: files that give any token without decoding a block.

An id is split into chunks of CHUNK bits, the lowest first; level k holds the k-th chunk of every id that has one, in
order, with a bitmap that says whether the id goes on to level k + 1.  A rank directory (ones before each BLOCK bits)
turns a position into the next level's position, so the ids [i, j) of a file are [rank(i), rank(j)) of every level.

File (little-endian): magic "DAC2", u32 levels, u32 documents, u32 zero, u64 ids, u64 places of the doc ids (i64), their
null flags (u8) and the document starts (u64, one more than documents), and for each level u64 length and places of its
chunk bytes, bitmap bytes and u32 ranks; then these parts; a line feed may follow.  Every part is found by its place, so
a reader seeks: one token takes a chunk byte, a rank and at most a block of bits a level.

Files lie at part=P/file=F/n_ids=N of a folder; their order is that of (P, F).  Spark's own committer writes them (its
text writer puts bytes out as they are), so a retried task leaves one copy, in any store that Spark writes to.

Defined results: a null or empty text is its end id; a null doc_id comes first; repeated rows are written each, in the
order of their ids; an empty table writes no file; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import id_bounds, new_path, ranges_for, text_bytes
from seqloom.llm.tokens import bases, ids_of, token_rows

CHUNK, BLOCK, END = 8, 512, 1
#: Ids after which a file is closed: bounds the memory of writer and reader, but for one longer document.
FILE_IDS = 1 << 21
HEAD, LEVEL = struct.Struct("<4sIIIQQQQ"), struct.Struct("<QQQQ")


def encode(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    ids = np.concatenate([d[1] for d in docs]) if docs else np.zeros(0, "<u4")
    starts = np.r_[0, np.cumsum([len(d[1]) for d in docs])].astype("<u8")
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        on = more > 0
        ones = np.add.reduceat(on.astype(np.uint32), np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, np.uint32)
        ranks = np.r_[0, np.cumsum(ones)].astype("<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), np.packbits(on, bitorder="little").tobytes(), ranks.tobytes()))
        if not on.any():
            break
        rest = more[on]
    null = np.array([d[0] is None for d in docs], np.uint8)
    names = np.array([0 if d[0] is None else d[0] for d in docs], "<i8")
    parts, places, at = [], [], HEAD.size + LEVEL.size * len(levels)
    for part in (names.tobytes(), null.tobytes(), starts.tobytes(), *(x for level in levels for x in level[1:])):
        places.append(at)
        parts.append(part)
        at += len(part)
    head = HEAD.pack(b"DAC2", len(levels), len(docs), 0, len(ids), *places[:3])
    table = b"".join(LEVEL.pack(level[0], *places[3 + 3 * k : 6 + 3 * k]) for k, level in enumerate(levels))
    return head + table + b"".join(parts)


class Reader:
    """Random access to one file: its bytes, or an open file that seeks."""

    def __init__(self, source: bytes | BinaryIO) -> None:
        self.source = source
        magic, levels, self.docs, _, self.n, *self.places = HEAD.unpack(self._read(0, HEAD.size))
        if magic != b"DAC2":
            raise ValueError("not a file of directly addressable codes")
        raw = self._read(HEAD.size, LEVEL.size * levels)
        self.levels = [LEVEL.unpack_from(raw, LEVEL.size * k) for k in range(levels)]

    def _read(self, at: int, size: int) -> bytes | memoryview:
        if isinstance(self.source, bytes):
            return memoryview(self.source)[at : at + size]
        self.source.seek(at)
        return self.source.read(size)

    def _take(self, kind: str, at: int, first: int, end: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self._read(at + first * width, (end - first) * width), kind)

    def doc_ids(self) -> list[int | None]:
        names, null = self._take("<i8", self.places[0], 0, self.docs), self._take("u1", self.places[1], 0, self.docs)
        return [None if z else v for v, z in zip(names.tolist(), null.tolist(), strict=True)]

    def starts(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids before each document, from document `first` on; one more than documents."""
        return self._take("<u8", self.places[2], first, self.docs + 1 if end is None else end).astype(np.int64)

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits: the directory's entry and less than a block of bits."""
        _, _, bits, ranks = self.levels[level]
        block = i // BLOCK
        some = np.unpackbits(self._take("u1", bits, block * BLOCK // 8, (i + 7) // 8), bitorder="little")[: i - block * BLOCK]
        return int(self._take("<u4", ranks, block, block + 1)[0]) + int(some.sum())

    def slice(self, i: int, j: int) -> np.ndarray:
        spans = [(i, j)]
        for k in range(len(self.levels) - 1):
            a, b = spans[-1]
            if a == b:
                break
            spans.append((self.rank(k, a), self.rank(k, b)))
        above = None
        for k in range(len(spans) - 1, -1, -1):
            (a, b), (_, chunks, bits, _) = spans[k], self.levels[k]
            out = self._take("u1", chunks, a, b).astype("<u4")
            if above is not None and len(above):
                on = np.unpackbits(self._take("u1", bits, a // 8, (b + 7) // 8), bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
                out[on] |= above << np.uint32(CHUNK)
            above = out
        return above

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.slice(*self.starts(k, k + 2).tolist())


def write_files(docs: DataFrame, end_id: int = END, file_ids: int = FILE_IDS, path: str | None = None, tokenizer: str | None = None) -> str:
    """Writes files in ascending doc_id order and returns their folder.

    Documents are dealt out by ranges of their ids (part), whose number comes from the bytes of the texts; they are
    tokenized before the shuffle and sorted within a range.  Rows of one id that fill several ranges are spread over
    them.
    """
    count = ranges_for(text_bytes(docs))
    path = path or new_path(docs.sparkSession, "dac")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, docs, size = -1, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal file, docs, size
            raw = pa.array([encode(docs)], pa.binary()).view(pa.string())  # the writer takes strings, and their bytes as they are
            row = [pa.array([part], pa.int64()), pa.array([file], pa.int64()), pa.array([size], pa.int64()), raw]
            file, docs, size = file + 1, [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "file", "n_ids", "payload"])

        for b in batches:
            for bucket, doc, width, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != part:
                    if docs:
                        yield close()
                    part, file = bucket, 0
                docs.append((doc, ids_of(raw, width)))
                size += len(docs[-1][1])
                if size >= file_ids:
                    yield close()
        if docs:
            yield close()

    rows = token_rows(docs, end_id, tokenizer, bounds=id_bounds(docs, count)).select("bucket", "doc_id", "width", "ids")
    ordered = rows.repartition(count, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    files = ordered.mapInArrow(run, "part long, file long, n_ids long, payload string")
    files.write.partitionBy("part", "file", "n_ids").text(path)
    return path


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """path, part, file, n_ids, content of the files of a folder; what is not asked for is not read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    if "part" not in raw.columns:  # no file, so no folder to take names from
        return spark.createDataFrame([], "path string, part long, file long, n_ids long, content binary")
    return raw.select("path", *[F.col(c).cast("long") for c in ("part", "file", "n_ids")], "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    names = file_table(spark, path).select("part", "file", "n_ids").collect()  # a row a file, from their names
    base = bases([((r["part"], r["file"]), r["n_ids"]) for r in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got, first = Reader(raw), base[part, file]
                starts, ids = got.starts(), got.slice(0, got.n)
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                cols = [pa.array(got.doc_ids(), pa.int64()), pa.array(first + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return file_table(spark, path).select("part", "file", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, end_id: int = END) -> DataFrame:
    return read_documents(docs.sparkSession, write_files(docs, end_id))
