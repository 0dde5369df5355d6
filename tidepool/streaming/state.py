"""Arbitrary state on streams: metric intervals per run, packing lanes.

Both keep their state in the query's state store, which Spark commits with the
micro-batch: a query that is stopped or killed goes on from its checkpoint as if
nothing had happened, and writes each row once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidepool.operators.metric_state import Metrics

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that list and map state need, while a query starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


# ------------------------------------------------- G4 on a stream: intervals

INTERVALS = "run string, eval_interval long, split string, metric string, total double, weight double, rows long, closed boolean"


#: Runs are dealt over this many lanes, each with one state.
LANES = 512
_OPEN = "run string, number long, split string, metric string, total double, weight double, rows long"


class _Intervals(StatefulProcessor):
    """Per lane of runs: each run's number of marks so far, and its open
    interval's sums by split and metric.  Rows of a micro-batch are taken in
    their order; a mark closes the run's interval and starts the next with
    nothing.  The runs of a lane are added up together, and its state is read
    and written as a whole, so a run costs no call of its own.

    The state is a list of sums, and for a run without sums a row without a
    metric that keeps its number."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows), ignore_index=True).sort_values(["at", "tiebreak"], kind="stable", ignore_index=True)
        had = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        had = pd.DataFrame({c.split(" ")[0]: pd.Series(x, dtype=object) for c, x in zip(_OPEN.split(", "), zip(*had) if had else [()] * 7)})
        runs, run_names = _codes(had["run"], log["run"])
        splits, split_names = _codes(had["split"], log["split"])
        old_run, new_run, old_split, new_split = runs[:len(had)], runs[len(had):], splits[:len(had)], splits[len(had):]
        number = np.zeros(len(run_names), np.int64)
        number[old_run] = had["number"].to_numpy(np.int64)
        mark = log["mark"].to_numpy(bool)
        interval = number[new_run] + pd.Series(mark).groupby(new_run).cumsum().to_numpy(np.int64)
        last, touched = number.copy(), np.zeros(len(run_names), bool)
        np.maximum.at(last, new_run, interval)
        touched[new_run] = True
        sums = []
        for k, name in enumerate(self.names):
            t, w = log[f"t{k}"].to_numpy(float), log[f"w{k}"].to_numpy(float)
            of, body = (had["metric"] == name).to_numpy(bool), ~(mark | np.isnan(t) | np.isnan(w))
            before = pd.DataFrame({"r": old_run[of], "i": number[old_run[of]], "s": old_split[of], "t": had["total"][of].to_numpy(float),
                                   "w": had["weight"][of].to_numpy(float), "n": had["rows"][of].to_numpy(np.int64)})
            now = pd.DataFrame({"r": new_run[body], "i": interval[body], "s": new_split[body], "t": t[body], "w": w[body], "n": 1})
            sums.append(pd.concat([before, now]).groupby(["r", "i", "s"], sort=False, as_index=False).sum().assign(metric=name))
        sums = pd.concat(sums, ignore_index=True)
        r, i = sums["r"].to_numpy(np.int64), sums["i"].to_numpy(np.int64)
        table = pd.DataFrame({"run": run_names[r], "eval_interval": i, "split": split_names[sums["s"].to_numpy(np.int64)], "metric": sums["metric"].to_numpy(object),
                              "total": sums["t"].to_numpy(float), "weight": sums["w"].to_numpy(float), "rows": sums["n"].to_numpy(np.int64), "closed": i < last[r]})
        still = table[~table["closed"].to_numpy(bool)]
        bare = np.setdiff1d(np.arange(len(run_names)), r[~table["closed"].to_numpy(bool)])
        state = list(zip(*(still[c].tolist() for c in ("run", "eval_interval", "split", "metric", "total", "weight", "rows"))))
        self.open.put(state + [(run_names[x], int(last[x]), None, None, None, None, None) for x in bare])
        yield table[touched[r]]

    def close(self) -> None:
        pass


def _codes(old: pd.Series, new: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the names of both, null being a name, and the names."""
    codes, names = pd.factorize(np.concatenate([old.to_numpy(object), new.to_numpy(object)]), use_na_sentinel=False)
    return codes, np.array([None if pd.isna(x) else x for x in names], dtype=object)


def interval_states(df: DataFrame, metrics: Metrics, run: str, at: Column, tiebreak: Column, is_mark: Column, split: Column, lanes: int = LANES) -> DataFrame:
    """G4 on a stream: states of every (run, interval, split, metric) that a
    micro-batch touches, ``closed`` once the mark that ends the interval has
    come.  A state holds all of its interval so far, so the last one written
    counts.  Rows must come in the order of ``at`` from batch to batch; in a
    batch any order will do.  A task holds the rows that a micro-batch has for
    one of ``lanes`` lanes of runs."""
    parts = [m.parts() for m in metrics.metrics.values()]
    rows = df.select(F.col(run).cast("string").alias("run"), at.cast("long").alias("at"), tiebreak.cast("long").alias("tiebreak"),
                     F.coalesce(is_mark, F.lit(False)).alias("mark"), split.cast("string").alias("split"),
                     *(c.cast("double").alias(f"{name}{k}") for k, both in enumerate(parts) for name, c in zip("tw", both)))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("run"), F.lit(lanes)))
    return rows.groupBy("lane").transformWithStateInPandas(_Intervals(list(metrics.metrics)), INTERVALS, "Update", "None")


# ------------------------------------------------------- T2 exact: lanes

CHUNKS = "lane long, chunk_id long, input_ids array<long>, labels array<long>"


class _Lanes(StatefulProcessor):
    """Per lane: the ids that are left over, and the number of the next chunk."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getListState("left", "id long")
        self.next = handle.getValueState("next", "chunk long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("key", kind="stable", na_position="first")
        old = np.fromiter((x[0] for x in self.left.get()), np.int64) if self.left.exists() else np.zeros(0, np.int64)
        ids = np.concatenate([old, *(np.asarray(x, np.int64) for x in batch["input_ids"] if x is not None)])
        first = self.next.get()[0] if self.next.exists() else 0
        n = len(ids) // self.length
        rest = ids[n * self.length:]
        if len(rest):
            self.left.put([(int(x),) for x in rest])
        else:
            self.left.clear()
        self.next.update((first + n,))
        chunks = list(ids[:n * self.length].reshape(n, self.length))
        lane = key[0] if isinstance(key, tuple) else key
        yield pd.DataFrame({"lane": pd.Series([lane] * n, dtype="Int64"), "chunk_id": np.arange(first, first + n), "input_ids": chunks, "labels": chunks})

    def close(self) -> None:
        pass


def lane_chunks(df: DataFrame, seq_length: int, lane: str, key: str, ids: str) -> DataFrame:
    """T2 exact: chunks ``(lane, chunk_id, input_ids, labels)``.  A lane's rows
    of a micro-batch follow the ids that the lane has left over, in key order;
    fewer than ``seq_length`` ids stay in the state store."""
    rows = df.select(F.col(lane).cast("long").alias("lane"), F.col(key).cast("long").alias("key"), F.col(ids).cast("array<long>").alias("input_ids"))
    return rows.groupBy("lane").transformWithStateInPandas(_Lanes(seq_length), StructType.fromDDL(CHUNKS), "Append", "None")
