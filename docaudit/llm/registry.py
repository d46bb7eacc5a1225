"""The queries of this package and their SQL."""

from . import exact_dedup, fill_middle, html_extract, importance, language_id, lm_score, mixing, ngram_join, packing, personal_data, quality_rules, secret_scan, toxicity

MODULES = [exact_dedup, mixing, packing, quality_rules, language_id, secret_scan, toxicity, ngram_join, html_extract, lm_score, importance, fill_middle, personal_data]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
