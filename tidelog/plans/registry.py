"""Queries of one module by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidelog.plans.views import oracle


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, *views: str) -> Callable:
        """Register a query (spark, sf_dir) under a name, with its SQL over the views."""

        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = oracle(sql, *views)
            return f

        return add
