"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries by name, SQL by name) of every plan module."""
    from . import anchors, classification, code, evaluation, extraction, find, gitlog, graph, history, listing, ranking, search, selection, state, structure

    queries: dict = {}
    sql: dict = {}
    for m in (listing, search, extraction, classification, ranking, graph, history, evaluation, state, selection, code, find, anchors, structure, gitlog):
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
