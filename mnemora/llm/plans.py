"""Registered queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("components_queries", "tokens_queries", "packing_queries", "neighbors_queries", "splitting_queries", "sentences_queries", "pairs_queries")


def _modules():
    return [import_module(f"mnemora.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
