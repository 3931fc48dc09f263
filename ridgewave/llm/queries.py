"""All queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import chat_format, exact_dedup, hard_negatives, html_extraction, language_id, licenses, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, vector_codes

_MODULES = (licenses, quality_rules, chat_format, token_counts, mixing, exact_dedup, near_dedup, quality_classifier, html_extraction, packing, vector_codes, hard_negatives, language_id)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
