"""The registered queries of the training-data operators: thin, each over its whole table."""

from __future__ import annotations

from seqloom.llm import decontaminate, direct_codes, licenses, packing, repeats, secret_ledger, simhash, text_density, toxicity
from seqloom.llm.common import table


def op9_secret_ledger(spark, sf_dir):
    return secret_ledger.digest(table(spark, sf_dir, "documents"))


def op1_repeated_bytes(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op2_license_sentences(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark, sf_dir):
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op4_pu_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_concat_and_cut(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_text_density(spark, sf_dir):
    return text_density.extract(table(spark, sf_dir, "pages"))


def op7_cgk_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_direct_codes(spark, sf_dir):
    return direct_codes.token_index(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_repeated_bytes": op1_repeated_bytes,
    "op2_license_sentences": op2_license_sentences,
    "op3_fingerprints": op3_fingerprints,
    "op4_pu_toxicity": op4_pu_toxicity,
    "op5_concat_and_cut": op5_concat_and_cut,
    "op6_text_density": op6_text_density,
    "op7_cgk_decontamination": op7_cgk_decontamination,
    "op8_direct_codes": op8_direct_codes,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op9_secret_ledger": op9_secret_ledger,
}
SQL = {
    "op9_secret_ledger": secret_ledger.SQL,
}
