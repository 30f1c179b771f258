"""The queries of the operators in this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

_HOMES = {
    "op1_html": "html",
    "op2_sharding": "sharding",
    "op3_host_rules": "quality",
    "op4_mixing": "mixing",
    "op5_near_duplicates": "jaccard",
    "op6_bpe": "bpe",
    "op7_chunks": "chunks",
    "op8_pii": "pii",
    "op9_neighbours": "neighbours",
    "op10_lines": "lines",
    "op11_classifier": "classifier",
    "op12_merkle": "merkle",
    "op13_search": "search",
}
_WITH_SQL = {"op3_host_rules": "quality", "op5_near_duplicates": "jaccard", "op10_lines": "lines", "op12_merkle": "merkle", "op13_search": "search"}


def queries() -> dict:
    return {name: getattr(import_module(f"graphstrata.llm.{home}"), name) for name, home in _HOMES.items()}


def oracle_sql() -> dict[str, str]:
    """Each module's ORACLE; queries that SQL can't express, or only too slowly, are tested against brute force."""
    return {name: import_module(f"graphstrata.llm.{home}").ORACLE for name, home in _WITH_SQL.items()}
