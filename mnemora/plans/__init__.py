"""Registered queries over the test tables, each module with QUERIES and, where SQL can state the result, SQL."""

from __future__ import annotations

from mnemora.plans import corpus_queries, event_queries, graph_queries, hierarchy_queries, more_queries, search_queries, text_queries

_MODULES = (hierarchy_queries, text_queries, search_queries, graph_queries, corpus_queries, event_queries, more_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
