"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Module of each query.
MODULES = {
    "op1_topk_search": "topk",
    "op2_html_text": "html_text",
    "op3_line_dedup": "line_dedup",
    "op4_simhash_near_dedup": "simhash",
    "op5_ogg_media": "ogg",
    "op6_token_counts": "token_counts",
    "op7_mixing": "mixing",
    "op8_pii": "pii",
    "op9_language_id": "language_id",
    "op10_byte_bpe": "byte_bpe",
}


def queries() -> dict:
    return {name: getattr(import_module(f"nestql.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES.values():
        found |= getattr(import_module(f"nestql.llm.{module}"), "SQL", {})
    return found
