"""Alphabets, codes, codons and other scalar functions as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: groups of letters with one code each, in order of code
GROUPS = {
    "protein23": "A R N D C Q E G H I L K M F P S T W Y V B Z XU".split(),
    "dna5": "A C G TU NRYSWKMBDHVX".split(),
    "reduced13": "AST IV LM KR EQZ NDB FY CU G H P W X".split(),
    "reduced6": "AM DEKNQRP CFIVU GHTS WLY BZX".split(),
    "protein21": "A C D E F G H I K L M N P Q R S T V W Y BZXU".split(),
}
# fixed values: the standard genetic code, codons in the order T C A G of each place
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def code_of(alphabet: str) -> dict[str, int]:
    return {c: i for i, group in enumerate(GROUPS[alphabet]) for c in group}


def encode(seq: Column, alphabet: str) -> Column:
    """Array of codes; a letter without a code gets 0."""
    codes = code_of(alphabet)
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.when(F.length(seq) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(F.upper(seq), ""), lambda c: F.coalesce(table[c], F.lit(0))))


def letters(seq: Column, alphabet: str) -> Column:
    """Codes as letters from 'a' on, by one translate()."""
    codes = code_of(alphabet)
    return F.translate(F.upper(seq), "".join(codes), "".join(chr(97 + v) for v in codes.values()))


def codons() -> dict[str, str]:
    return {"".join(c): CODE[i] for i, c in enumerate(product("TCAG", repeat=3))}


def translate_dna(dna: Column, strict: bool = False) -> Column:
    """Protein of codons; an unknown codon gives X, stops are left out.  Letters after the last whole codon are left out, or,
    if strict, an error."""
    if strict:
        told = F.concat(F.lit("a length of "), F.length(dna).cast("string"), F.lit(" is no multiple of three"))
        dna = F.when(F.length(dna) % 3 != 0, F.raise_error(told).cast("string")).otherwise(dna)
    table = F.create_map(*[F.lit(x) for pair in codons().items() for x in pair])
    count = F.floor(F.length(dna) / 3).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.replace(F.array_join(F.transform(steps, lambda i: F.coalesce(table[F.upper(dna.substr(i * 3 + 1, F.lit(3)))], F.lit("X"))), ""), F.lit("*"), F.lit(""))


def back_translate(aligned: Column, dna: Column) -> Column:
    """Codons in place of the residues of an aligned protein, '---' for gaps; other numbers of residues and codons are an error.

    The row is cut at its gaps: a run of residues takes as many codons from where the runs before it ended, so work is
    linear in the row.
    """
    runs = F.regexp_extract_all(aligned, F.lit("-+|[^-]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, run: Column) -> Column:
        gap = F.startswith(run, F.lit("-"))
        codons = dna.substr(acc["at"] * 3 + 1, F.length(run) * 3)
        return F.struct((acc["at"] + F.when(gap, 0).otherwise(F.length(run))).alias("at"), F.array_append(acc["out"], F.when(gap, F.repeat(F.lit("-"), F.length(run) * 3)).otherwise(codons)).alias("out"))

    n = F.length(F.translate(aligned, "-", ""))
    told = F.concat(n.cast("string"), F.lit(" residues and "), F.length(dna).cast("string"), F.lit(" nucleotides"))
    return F.when(n * 3 != F.length(dna), F.raise_error(told).cast("string")).otherwise(F.aggregate(runs, start, step, lambda acc: F.array_join(acc["out"], "")))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def infer_type(seq: Column) -> Column:
    """'DNA', 'RNA' or 'protein' by the letters that occur; without any, 'DNA'."""
    seen = F.filter(F.array_distinct(F.split(F.regexp_replace(F.upper(seq), "[-.]", ""), "")), lambda c: c != "")
    within = lambda s: F.size(F.array_except(seen, F.array(*[F.lit(c) for c in s]))) == 0
    return F.when(within("ACGTN"), "DNA").when(within("ACGUN"), "RNA").otherwise("protein")
