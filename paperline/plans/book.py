"""A decorator that files a query under its name with its SQL."""

from __future__ import annotations

from collections.abc import Callable


def book() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None) -> Callable:
        def file(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return file

    return queries, oracles, query
