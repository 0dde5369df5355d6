"""Names of the queries of this package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame``; ``sql`` is None where SQL
    cannot express the rows (those are tested against brute force)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco
