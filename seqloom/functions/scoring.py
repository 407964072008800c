"""Alphabets and scores for alignment.  Protein scores come from a rule over residue properties, or from the caller."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np

PROTEIN, NUCLEOTIDE = "ARNDCQEGHILKMFPSTWYVBZX", "ACGTN"
# fixed values: residue classes; letters that share one exchange easily
CLASSES = ("ILVM", "FWY", "KRH", "DE", "NQ", "ST", "AG", "C", "P", "DNB", "EQZ", "AST", "ILVMFWYAC", "KRHDENQSTBZ", "GP", "HKR", "FYH")


def protein_matrix() -> np.ndarray:
    """Identity scores by how rare a residue's classes are; others by the classes they share."""
    n = len(PROTEIN)
    shared = np.array([[sum(a in c and b in c for c in CLASSES) for b in PROTEIN] for a in PROTEIN], np.float32)
    out = -2.0 + 1.6 * shared
    for i, a in enumerate(PROTEIN):
        size = min((len(c) for c in CLASSES if a in c), default=20)
        out[i, i] = 4.0 + 3.0 / size
    x = PROTEIN.index("X")
    out[x, :] = out[:, x] = -0.5
    return (out + out.T)[:n, :n] / 2


def nucleotide_matrix(kind: str = "dna") -> np.ndarray:
    """Over A, C, G, T and N."""
    if kind != "rna":
        out = np.full((5, 5), -4.0, np.float32)
        np.fill_diagonal(out, 5.0)
        return out
    # fixed values: the published scores of nucleotides in structural alignments, raised so that all are above zero
    own = [[91, -114, -31, -123], [-114, 100, -125, -31], [-31, -125, 100, -114], [-123, -31, -114, 91]]
    out = np.full((5, 5), 283.0, np.float32)
    out[:4, :4] += np.array(own, np.float32)
    return out


def matrix_file(path: str, letters: str = PROTEIN) -> np.ndarray:
    """A matrix from a text table: a line of letters, then a line a letter of its name and scores ('#' begins a comment).

    Letters that the table lacks score as X, or as its least score.
    """
    rows = [line.split() for line in open(path, encoding="utf-8") if line.strip() and not line.startswith("#")]
    names = rows[0]
    held = {r[0]: dict(zip(names, map(float, r[1:]), strict=True)) for r in rows[1:]}
    least = min(v for r in held.values() for v in r.values())
    pick = lambda a: a if a in held else "X" if "X" in held else None
    return np.array([[held[pick(a)][pick(b)] if pick(a) and pick(b) else least for b in letters] for a in letters], np.float32)


def _codes_of(letters: str) -> dict[str, int]:
    table = {c: i for i, c in enumerate(letters)}
    table["U"] = table.get("T", table.get("X", 0))
    return table


@lru_cache
def code_table(letters: str) -> np.ndarray:
    """The code of each ASCII character; what has none has the last."""
    table = _codes_of(letters)
    return np.array([table.get(chr(c).upper(), len(letters) - 1) for c in range(128)], np.int64)


@dataclass(frozen=True)
class Scores:
    letters: str
    matrix: np.ndarray = field(repr=False)
    gap_open: float
    gap_extend: float
    gap_terminal: float
    #: Taken off every residue score, for divergent families: max(0, most - mean distance).
    offset_most: float = 0.0

    def codes(self, seq: str) -> np.ndarray:
        if seq.isascii():
            return code_table(self.letters)[np.frombuffer(seq.encode(), np.uint8)]
        table = _codes_of(self.letters)
        return np.array([table.get(c, len(self.letters) - 1) for c in seq.upper()], np.int64)

    def scaled(self, o: float, e: float, t: float) -> Scores:
        return replace(self, gap_open=self.gap_open * o, gap_extend=self.gap_extend * e, gap_terminal=self.gap_terminal * t)


# fixed values: penalties of each type (opening, extension, terminal), and the factor on the rule's protein scores that
# goes with them
PROTEINS = {"protein": (7.0, 1.25, 1.0, 1.0), "pfasum43": (7.0, 1.25, 1.0, 1.0), "pfasum60": (7.0, 1.25, 1.0, 1.0), "corblosum66": (5.5, 2.0, 1.0, 0.8), "divergent": (55.0, 8.0, 4.0, 8.0)}
NUCLEOTIDES = {"dna": (8.0, 6.0, 0.0), "internal": (8.0, 6.0, 8.0), "rna": (217.0, 39.4, 292.6)}


def type_for(asked: str, seqs: list[str]) -> str:
    """The type that sequences are scored by: what is asked for, else 'protein' or 'rna' by their letters.

    A nucleotide type for proteins, or 'protein' for nucleotides, is an error; other protein types for nucleotides give
    'rna'.  'pfasum_auto' takes pfasum43 where the longest is under one and a half times the shortest, else pfasum60.
    """
    if asked not in ("", "auto", "pfasum_auto", *PROTEINS, *NUCLEOTIDES):
        raise ValueError(f"unknown kind of sequence: {asked}")
    found = kind_of(seqs)
    if found == "protein":
        if asked in NUCLEOTIDES:
            raise ValueError(f"protein sequences, but type {asked}")
        if asked == "pfasum_auto":
            sizes = [len(x) for x in seqs if x] or [1]
            return "pfasum43" if max(sizes) / min(sizes) < 1.5 else "pfasum60"
        return asked if asked in PROTEINS else "protein"
    if asked == "protein":
        raise ValueError("nucleotide sequences, but type protein")
    return asked if asked in NUCLEOTIDES else "rna"


def scores_for(kind: str, gap_open: float = -1, gap_extend: float = -1, gap_terminal: float = -1, matrix: np.ndarray | None = None) -> Scores:
    """Defaults of a type; penalties of 0 or more, and a matrix, override them.

    The protein types differ in their penalties; their scores follow the rule of protein_matrix unless a matrix is given
    (see matrix_file).
    """
    if kind in PROTEINS:
        o, e, t, factor = PROTEINS[kind]
        base = Scores(PROTEIN, protein_matrix() * np.float32(factor), o, e, t, 2.0)
    elif kind in NUCLEOTIDES:
        base = Scores(NUCLEOTIDE, nucleotide_matrix(kind), *NUCLEOTIDES[kind])
    else:
        raise ValueError(f"unknown kind of sequence: {kind}")
    pick = lambda v, d: v if v >= 0 else d
    return replace(base, matrix=base.matrix if matrix is None else matrix, gap_open=pick(gap_open, base.gap_open), gap_extend=pick(gap_extend, base.gap_extend), gap_terminal=pick(gap_terminal, base.gap_terminal))


def kind_of(seqs: list[str]) -> str:
    """'dna' or 'protein', the likelier of two letter models over all letters."""
    text = "".join(seqs).upper()
    nucleotides = sum(c in "ACGTUN" for c in text)
    dna = nucleotides * np.log(0.9999 / 12) + (len(text) - nucleotides) * np.log(0.0001 / 116)
    letters = sum(c in "ACDEFGHIKLMNPQRSTVWY" for c in text)
    protein = letters * np.log(0.9999 / 40) + (len(text) - letters) * np.log(0.0001 / 88)
    return "dna" if dna >= protein else "protein"
