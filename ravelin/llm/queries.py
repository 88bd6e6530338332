"""The corpus queries: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from . import cohorts, decontamination, exact_dedup, licenses, line_dedup, pii, secrets, sequences, simhash, suffix_dedup, toxicity, vector_codes
from .common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return sequences.linear_grouping(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_token_output(spark, sf_dir):
    return sequences.packed_digest(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op11_license_scan(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op12_cohort_retention(spark, sf_dir):
    return cohorts.retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_secret_scan, op3_line_dedup, op4_best_fit_packing, op5_simhash_near_dedup,
        op6_decontamination, op7_exact_dedup, op8_token_output, op9_pii, op10_suffix_dedup,
        op11_license_scan, op12_cohort_retention, op13_vector_codes,
    )
}

ORACLES = {
    "op2_secret_scan": secrets.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op12_cohort_retention": cohorts.ORACLE, "op13_vector_codes": vector_codes.ORACLE,
}
