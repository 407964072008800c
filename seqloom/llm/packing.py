"""Concatenate and cut: documents as one stream of ids, cut into windows of a fixed length.

Two passes of prefix sums give global offsets without moving a document: each input partition numbers its own ids, the
partitions' totals (a row each) give their bases, and every document then cuts itself at multiples of the window.
Windows that cross documents or partitions are made of boundary records, the pieces.

Defined results: a null or empty text is its end id; repeated rows are packed each; an empty table packs nothing;
columns beside doc_id and text are ignored.  Only the last sequence is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.tokens import Encoder, bases, ids_of, token_table

WINDOW, END = 4096, 2


def pieces(tokens: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, four bytes each)."""
    base = bases([(r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for part, local, doc, n, width, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, first = ids_of(raw, width), base[part] + local
                at = 0
                while at < n:
                    seq, offset = divmod(first + at, window)
                    size = min(window - offset, n - at)
                    own = ids[at : at + size].tobytes()
                    for col, v in zip(out, (doc, at, size, zlib.crc32(own), n, seq, offset, own), strict=True):
                        col.append(v)
                    at += size
            cols = [pa.array(c, pa.int64()) for c in out[:7]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[7], pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids
    return tokens.select("part", "local_start", "doc_id", "n_tokens", "width", "ids").mapInArrow(run, schema)


def sequences(tokens: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (array of exactly `window` ids): the boundary records put together."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, raws in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.full(window, pad_id, np.int32)
                ids[:n] = np.frombuffer(b"".join(r["ids"] for r in raws), "<u4")
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in out], pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "ids"])

    whole = pieces(tokens, window, with_ids=True).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.mapInArrow(fill, "sequence_id long, n_tokens long, ids array<int>")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END, kept: int = Encoder.KEPT) -> DataFrame:
    """pieces of documents.  kept: pieces of text that a worker remembers the ids of; fewer take less memory and more time."""
    return pieces(token_table(docs, end_id, kept=kept), window)
