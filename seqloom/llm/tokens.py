"""Token ids of whole texts by a public tokenizer, as a written table.

Defined results: a null text is empty and holds the end id alone; repeated rows are texts of their own; an empty table
gives an empty table; a very long text is encoded piece by piece.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import FIRST, slices, whole_text, written

FILE = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


class Encoder(dict):
    """ids of a text as little-endian unsigned bytes (two for vocabularies under 2^16, else four).

    This vocabulary's rules drop white space, never look across it, lower the case and keep letters apart from signs, so
    a text's ids are those of its pieces between white space, a closing stop or comma is a piece of its own, and in
    Latin-1 a capital's ids are its small letter's.  Pieces met before are looked up: the dictionary is from pieces to ids.

    The strings of special tokens in a text become their ids, as the library does by itself; with special_as_text they
    are ordinary text.  kept: pieces that the dictionary holds, some 200 bytes each.
    """

    KEPT, LONGEST = 1_000_000, 48

    def __init__(self, path: str, special_as_text: bool = False, kept: int = KEPT) -> None:
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # texts with the beginning that all special tokens share go to the tokenizer whole
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix([t.lower() for t in special]) if special and not special_as_text else None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.model, self.code = self.tokenizer.model, "H" if self.kind.itemsize == 2 else "I"
        self.signs = {c: self._plain(c) for c in ".,"}
        # a small Latin-1 word is one piece of the model's, its bytes as the byte alphabet's letters
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.letters = {c: "".join(hidden.get(b, chr(b)) for b in chr(c).encode()) for c in range(128, 256)}
        tried = ["strength", "éèñüß", "w", "unbelievably", "ÿµ", "großzügigkeit"]
        self.direct = all(self._word(w) == self._plain(w) for w in tried) and sys.byteorder == "little"

    def _plain(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        """ids of a piece not known yet, by way of its plain word; kept unless it is very long."""
        if len(piece) > self.LONGEST:
            return self._plain(piece)
        sign, word = b"", piece
        if piece[-1:] in self.signs and piece[:-1].isalpha():
            sign, word = self.signs[piece[-1]], piece[:-1]
        if self.direct and word.isalpha() and (word.isascii() or max(word) < "\u0100"):
            word = word.lower()
            ids = self.get(word)
            if ids is None:
                ids = self[word] = self._word(word)
        else:
            ids = self._plain(word)
        out = self[piece] = ids + sign
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.kept:
            self.clear()
        of = self.__getitem__
        # str.split() also cuts at four control characters that the vocabulary takes for signs
        return [self._plain(t) if self._has_special(t) else b"".join(map(of, t.replace("\n", " ").split(" ") if any(map(t.__contains__, _ODD)) else t.split())) for t in texts]

    def _has_special(self, text: str) -> bool:
        """Whether a text may hold a special token, in any case."""
        start = self.special
        if start is None:
            return False
        return start in (text if start.lower() == start.upper() else text.lower())


_ODD = "\x1c\x1d\x1e\x1f"
_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, special_as_text: bool = False, kept: int = Encoder.KEPT) -> Encoder:
    """One for each worker process, which serves many tasks."""
    name = path, special_as_text, kept
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(path, special_as_text, kept)
    return _ENCODERS[name]


def token_rows(docs: DataFrame, end_id: int, path: str | None = None, bounds: list[int] = (), batch_chars: int = 600_000, special_as_text: bool = False, kept: int = Encoder.KEPT) -> DataFrame:
    """part, local_start (ids before it in its part), doc_id, bucket, n_tokens, width (bytes an id), ids.

    part is the input partition, in whose order the rows stand; bucket is doc_id's range by bounds, or, if the id is a
    bound or several equal ones, one of the ranges on both sides, by the text; ids end with end_id.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(path, special_as_text, kept), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], own.kind).tobytes(), own.kind.itemsize

        def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal at
            got = [x + end for x in own.encode(texts)]
            n = np.array([len(x) // width for x in got], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            keys = np.array([FIRST if i is None else i for i in ids], np.int64)
            low, high = (np.searchsorted(bounds, keys, side=side).astype(np.int64) for side in ("left", "right"))
            bucket = low + np.array([zlib.crc32(x) for x in got], np.int64) % (high - low + 1)
            cols = [pa.array([part] * len(n), pa.int64()), pa.array(starts), pa.array(ids, pa.int64()), pa.array(bucket), pa.array(n), pa.array([width] * len(n), pa.int32()), pa.array(got, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "local_start", "doc_id", "bucket", "n_tokens", "width", "ids"])

        for b in slices(batches):
            ids, texts, chars = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                chars += len(t)
                if chars > batch_chars:
                    yield rows(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "part long, local_start long, doc_id long, bucket long, n_tokens long, width int, ids binary")


def token_table(docs: DataFrame, end_id: int, path: str | None = None, kept: int = Encoder.KEPT) -> DataFrame:
    """token_rows as a written table."""
    return written(token_rows(docs, end_id, path, kept=kept), "tokens")


def ids_of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def bases(totals: list[tuple]) -> dict:
    """key -> sum of the totals of the keys before it; a row for each partition or shard, not for each document."""
    out, at = {}, 0
    for key, n in sorted(totals):
        out[key] = at
        at += n
    return out
