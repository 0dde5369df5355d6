"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import scratch_path

#: A side of a join is broadcast only when it was counted to hold at most
#: this many rows of a few numbers each (about 50 MB when hashed).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of the data folder, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file (a folder of such files may be
    named in TOKENIZER_DIR)."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


#: Texts that a Python worker gets in one Arrow batch.
BATCH = "16m"
#: The same where a row depends on no other of its batch.
SMALL_BATCH = "4m"


def in_batches(df: DataFrame, most: str = BATCH) -> DataFrame:
    """``df``, after lowering the session's bound of an Arrow batch to ``most``
    if it is above that: a worker and the buffers that feed it hold a few
    batches at a time, and Spark's own bound lets them grow to several hundred
    MB.  Operators whose rows do not depend on their batches ask for less."""
    spark, key, own = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", "spark.tidepool.arrow.bytes"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    now, seen = spark.conf.get(key), spark.conf.get(own, "").split(",")
    if now != seen[-1]:  # what was not set here is the bound of the session
        seen = [now]
    bound = seen[0]
    lower = most if size(bound) <= 0 or size(bound) > size(most) else bound
    spark.conf.set(own, f"{bound},{lower}")
    spark.conf.set(key, lower)
    return df


#: Rows of one batch that a Python worker gives back.
ROWS = 1 << 16


def pieces(batch: pa.RecordBatch, rows: int = ROWS):
    """``batch`` in runs of at most ``rows`` rows: the executor holds a batch
    that comes back whole, outside its heap, and keeps that room."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_kept: list = []


def kept(f):
    """Results of ``f`` that a worker process keeps between its tasks, until
    another operator calls :func:`let_go` there."""
    f = lru_cache(maxsize=2)(f)
    _kept.append(f)
    return f


def let_go() -> None:
    """A worker that other operators used before gives back what they kept, and
    the room that it does not use: Spark hands workers on from one operator to
    the next."""
    if any(f.cache_info().currsize for f in _kept):
        for f in _kept:
            f.cache_clear()
    trim()


def trim() -> None:
    """Give back the room that this process does not use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:  # of glibc
        give(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that
    later steps neither recompute it nor depend on a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, which is saved, holds at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it was counted to be within ``limit``
    rows; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if fits(df, limit) else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``.

    Returns ``(id, component)`` for every end of an edge, ``component`` being
    the smallest id that can be reached.  Alternates the two star steps of
    Kiveris et al. (large star, small star) until every node but the roots has
    one neighbour, its root; every step is a partial aggregation and a key join
    (of a broadcast table where the nodes are few), written to the checkpoint
    folder.  No component is ever gathered in one place.  Loops and repeated
    edges are allowed; rows with a null end are ignored.
    """
    e = (edges.where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    e, few = saved(e, "cc"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")), "low")
        if low.where("m < u and top <> m").isEmpty():
            return low.select(F.col("u").alias("id"), F.least("u", "m").alias("component"))
        few = few or fits(low)  # no step adds a node
        mark = F.broadcast if few else lambda df: df
        big = both.where("v > u").join(mark(low.select("u", F.least("u", "m").alias("m"))), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big if few else big.distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        e = (big.join(mark(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(low.select("u", F.col("m").alias("v"))))
        e = saved(e if few else e.distinct(), "cc")  # an edge gives one edge: repeated ones need not go
