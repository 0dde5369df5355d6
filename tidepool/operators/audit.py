"""Reject counts taken by the scan that does the work (V1–V4, P3, F-filters).

An ``Audit`` gives each row a reason to be rejected, or none, keeps the rows
without one, and counts all reasons beside the result with Spark's observed
metrics: no second scan, no shuffle, no table of rejects.  Counts are there
once an action over the kept rows has ended.  On a stream, every micro-batch
writes its counts under its own number (``streams.write_audited``).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

KEPT = "kept"


class Audit:
    """``checks`` maps a reason to its predicate, true where a row is to be
    rejected; a row's reason is the first that holds.  A predicate that is null
    does not reject."""

    def __init__(self, checks: Mapping[str, Column]):
        if not checks or KEPT in checks:
            raise ValueError(f"an audit needs a reason, and none called {KEPT!r}")
        self.checks = dict(checks)
        self._seen: Observation | None = None

    def reason(self) -> Column:
        """The first reason that holds, null for none."""
        return F.coalesce(*(F.when(c, F.lit(name)) for name, c in self.checks.items()))

    def kept(self, df: DataFrame, with_reason: str | None = None) -> DataFrame:
        """Rows without a reason, counted as they pass; ``with_reason`` names a
        column and keeps all rows instead."""
        column = with_reason or "_reason"
        seen = self._seen = Observation(f"audit-{uuid.uuid4().hex}")
        known = [F.count_if(F.col(column) == name).alias(f"n{k}") for k, name in enumerate(self.checks)]
        df = df.withColumn(column, self.reason()).observe(seen, F.count(F.lit(1)).alias("rows"), *known)
        return df if with_reason else df.where(F.col(column).isNull()).drop(column)

    def counts(self) -> dict[str, int]:
        """Rows by reason, and those kept; waits for the action to end."""
        if self._seen is None:
            raise ValueError("nothing was audited yet")
        got = self._seen.get
        out = {name: int(got[f"n{k}"]) for k, name in enumerate(self.checks)}
        return {**out, KEPT: int(got["rows"]) - sum(out.values())}

    def report(self, df: DataFrame) -> DataFrame:
        """``counts`` as a table ``(reason, n)`` in the session of ``df``."""
        return df.sparkSession.createDataFrame(list(self.counts().items()), "reason string, n long")
