"""Registry of named queries: Spark callable + DuckDB oracle SQL.

``register(name, sql=...)`` decorates a ``(spark, sf_dir) -> DataFrame``
function.  ``sql=None`` marks an operator that is not SQL-expressible; the
driver then records a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from tidepool.plans import (chat_queries, corpus_queries, split_queries,  # noqa: F401
                                sequence_queries, noise_queries, metric_queries,
                                stream_queries, io_queries)
