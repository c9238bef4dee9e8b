"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprint, language, license_scan, ngram_join, packing, quality, sharding, toxicity, url_filter

QUERIES = {
    "op1_document_fingerprints": fingerprint.query,
    "op2_best_fit_packing": packing.query,
    "op3_language_id": language.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_url_filters": url_filter.query,
    "op6_license_scans": license_scan.query,
    "op7_sharding": sharding.query,
    "op8_quality_classifier": quality.query,
    "op9_toxicity": toxicity.query,
    "op10_ngram_jaccard_join": ngram_join.query,
}

ORACLE_SQL = {
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op5_url_filters": url_filter.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
}
