"""Pairs a query with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from .views import ctes


class Registry:
    def __init__(self):
        self.QUERIES: dict = {}
        self.ORACLE_SQL: dict[str, str] = {}

    def add(self, sql: str | None = None, views: tuple[str, ...] = ()):
        """Register the decorated query under its own name; ``views`` become CTEs in front of ``sql``."""

        def keep(query):
            self.QUERIES[query.__name__] = query
            if sql is not None:
                self.ORACLE_SQL[query.__name__] = (ctes(*views) if views else "") + sql
            return query

        return keep
