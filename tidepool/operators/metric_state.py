"""Metric collections as mergeable states.

A collection names metrics; each adds up a value and a weight over rows and is
finished by a function of the sums: a mean, a perplexity, a total, or the
caller's own.  A *state* is a row ``(keys…, metric, total, weight, rows)``.
States of any two parts of the data (intervals, splits, runs, micro-batches,
jobs before and after a restart) merge by adding up, without the raw rows, and
only a finished table needs the functions.

Rows whose value or weight is null take no part.  A metric that has no weight is
null, not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "metric string, total double, weight double, rows long"
Finish = Callable[[Column, Column, Column], Column]


def mean(total: Column, weight: Column, rows: Column) -> Column:
    return F.when(weight != 0, total / weight)


def perplexity(total: Column, weight: Column, rows: Column) -> Column:
    """exp of a mean of negative log-likelihoods."""
    return F.exp(mean(total, weight, rows))


def bits(total: Column, weight: Column, rows: Column) -> Column:
    """A mean of natural logarithms in bits."""
    return mean(total, weight, rows) / F.log(F.lit(2.0))


def summed(total: Column, weight: Column, rows: Column) -> Column:
    return total


@dataclass(frozen=True)
class Metric:
    """``sum(value * weight)`` over ``sum(weight)``, finished by ``finish``."""

    value: Column
    weight: Column | None = None
    finish: Finish = mean

    def parts(self) -> tuple[Column, Column]:
        """What a row adds to the total and to the weight."""
        weight = F.lit(1.0) if self.weight is None else self.weight.cast("double")
        both = self.value.isNotNull() & weight.isNotNull()
        return F.when(both, self.value.cast("double") * weight), F.when(both, weight)


class Metrics:
    """A collection of metrics by name; splits other than ``train`` get their
    name before the metric's in the log."""

    def __init__(self, metrics: Mapping[str, Metric]):
        if not metrics:
            raise ValueError("a collection needs a metric")
        self.metrics = dict(metrics)

    def _checked(self, states: DataFrame) -> DataFrame:
        for c in ("metric", "total", "weight", "rows"):
            if c not in states.columns:
                raise ValueError(f"not a table of states: it has no column {c!r}")
        return states

    def states(self, df: DataFrame, *keys: str | Column) -> DataFrame:
        """The states of each group of ``keys``: one partial aggregation for
        all metrics.  Metrics without a row in a group have no state there."""
        sums = []
        for k, m in enumerate(self.metrics.values()):
            total, weight = m.parts()
            sums += [F.sum(total).alias(f"_t{k}"), F.sum(weight).alias(f"_w{k}"), F.count(total).alias(f"_n{k}")]
        wide = df.groupBy(*keys).agg(*sums)
        names = [c for c in wide.columns if c[:2] not in ("_t", "_w", "_n")]
        each = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"_t{k}").alias("total"), F.col(f"_w{k}").alias("weight"), F.col(f"_n{k}").alias("rows"))
                         for k, name in enumerate(self.metrics)))
        return wide.select(*names, F.explode(each).alias("_s")).select(*names, "_s.*").where("rows > 0")

    def merge(self, states: DataFrame | Iterable[DataFrame], *keys: str | Column) -> DataFrame:
        """States of some tables (of one, rolled up to fewer keys) as one."""
        parts = [states] if isinstance(states, DataFrame) else list(states)
        both = reduce(lambda a, b: a.unionByName(b), map(self._checked, parts))
        return both.groupBy(*keys, "metric").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"), F.sum("rows").alias("rows"))

    def finished(self, states: DataFrame, out: str = "value") -> DataFrame:
        """The value of each state; a metric that the collection does not have
        raises when its row is read."""
        unknown = F.raise_error(F.concat(F.lit("no metric is called "), F.coalesce("metric", F.lit("null")))).cast("double")
        value = None
        for name, m in self.metrics.items():
            own = m.finish(F.col("total"), F.col("weight"), F.col("rows"))
            value = F.when(F.col("metric") == name, own) if value is None else value.when(F.col("metric") == name, own)
        return self._checked(states).withColumn(out, value.otherwise(unknown))

    def logged(self, states: DataFrame, split: str = "split") -> DataFrame:
        """``finished`` with ``key``, the name in the log."""
        name = F.when(F.col(split) == "train", F.col("metric")).otherwise(F.concat(F.col(split), F.lit("_"), F.col("metric")))
        return self.finished(states).withColumn("key", name)


def save_states(states: DataFrame, path: str, part: str) -> None:
    """Write the states of one part of the data (a day, a job).  The same part
    written again replaces itself, so a job that runs twice adds nothing."""
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")
