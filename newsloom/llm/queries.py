"""Registered queries of the llm operators and their DuckDB oracles."""

from __future__ import annotations

from newsloom.llm import (align_tokenizers, decontaminate, html_extract, license_scan, lm_score, near_dedup, packing,
                          quality_classifier, quality_rules, source_audit, token_counts, token_files, url_filter)

_MODULES = (packing, quality_classifier, html_extract, quality_rules, token_files, decontaminate, license_scan, lm_score,
            token_counts, near_dedup, align_tokenizers, source_audit, url_filter)


def registry():
    queries, oracles = {}, {}
    for m in _MODULES:
        queries.update(m.QUERIES)
        oracles.update(m.ORACLES)
    return queries, oracles
