"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from mediaframe.llm import infill, language, licenses, matroska, mixing, near_dup, packing, suffix_dedup, token_files, topk, toxicity, vector_codes, warc

MODULES = [toxicity, warc, mixing, suffix_dedup, matroska, packing, licenses, near_dup, language, topk, infill, token_files, vector_codes]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
