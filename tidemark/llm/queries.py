"""Queries of the subpackage, and their SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, filter_audit, html_extract, language_id, line_dedup, merkle_manifest, mixing, near_dedup, ngram_join, pii, quality_rules, suffix_dedup, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_repeated_spans": suffix_dedup.query,
    "op4_url_filter": url_filter.query,
    "op5_quality_rules": quality_rules.query,
    "op6_source_mixing": mixing.query,
    "op7_language_id": language_id.query,
    "op8_pii": pii.query,
    "op9_decontamination": decontaminate.query,
    "op10_html_extraction": html_extract.query,
    "op11_merkle_manifest": merkle_manifest.query,
    "op12_ngram_jaccard": ngram_join.query,
    "op13_filter_interactions": filter_audit.query,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op8_pii": pii.oracle(),
    "op11_merkle_manifest": merkle_manifest.ORACLE,
    "op12_ngram_jaccard": ngram_join.ORACLE,
    "op13_filter_interactions": filter_audit.ORACLE,
}
