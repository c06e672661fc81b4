"""Registers queries under their functions' names, each with the SQL that it is checked with."""

from __future__ import annotations


def registry() -> tuple[dict, dict[str, str], object]:
    """(QUERIES, SQL, query): two tables and the decorator that fills them."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
