"""Structured Streaming versions of the corpus path.

* ``stream_corpus`` — one file stream per source of a spec, read where the
  table lies, with a declared schema (no row probe, T3), combined by streaming
  ``union`` (U3).  How many files a trigger takes is the caller's choice.
* ``concat_streams`` — U3 in the order of the sources, with positions.
* ``stream_take`` — streaming ``limit`` (L5).
* T1 — the batch operators (F4, F5, A4 …) are plain ``select``/``where`` and
  apply unchanged to streaming DataFrames.
* ``pack_per_batch`` — T2 in the reference's shape: every micro-batch is packed
  on its own, in groups of rows (tails are lost per group).
* ``pack_lanes`` — T2 exact: each lane's leftover ids stay in the state store,
  so chunk borders do not depend on batch boundaries.
* ``split_stream`` — L4 on a stream: positions by source, carried from one
  micro-batch to the next in a small table.
* ``running_metrics`` / ``write_updates`` — T4: streaming aggregation of the
  weighted means; each micro-batch writes the keys that changed.
* ``interval_metrics`` — G4 on a stream: metric state per run that starts anew
  at every evaluation mark.

Writes of ``foreachBatch`` are named by the batch id and overwrite, so a batch
that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.operators import pack as pk
from tidepool.operators.audit import Audit
from tidepool.operators.metric_state import Metrics
from tidepool.operators.split import global_rank
from tidepool.sources.spec import Source, SpecError, find_loader, parse
from tidepool.streaming.state import interval_states, lane_chunks, state_store


@dataclass
class StreamTable:
    """What a stream loader gives: where the files lie, their schema, and
    what is selected from them."""

    path: str
    schema: StructType
    select: Callable[[DataFrame], DataFrame] = lambda df: df


def read_stream(spark: SparkSession, table: StreamTable, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = table.path.rstrip("/").rpartition("/")
    if not _is_folder(spark, table.path):  # a table of one file: its folder, that name only
        return table.select(reader.option("pathGlobFilter", name).parquet(folder))
    return table.select(reader.parquet(table.path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_corpus(spark: SparkSession, spec: str, registry: dict, root: str,
                  files_per_trigger: int | None = None) -> tuple[DataFrame, list[Source]]:
    """S4 + U3: the sources of ``spec`` as one stream with a ``source_rank``
    column (Spark keeps no order across sources), and the sources, whose
    limits ``split_stream`` applies.  Loaders take their options from the
    mapping and return a ``StreamTable``; what they leave is an error."""
    frames, sources = stream_sources(spark, spec, registry, root, files_per_trigger)
    return reduce(DataFrame.union, (df.withColumn("source_rank", F.lit(k)) for k, df in enumerate(frames))), sources


def stream_sources(spark: SparkSession, spec: str, registry: dict, root: str,
                   files_per_trigger: int | None = None) -> tuple[list[DataFrame], list[Source]]:
    """A stream for each source of ``spec``."""
    sources, frames = parse(spec), []
    if not sources:
        raise SpecError("the dataset spec names no source")
    for s in sources:
        options = dict(s.options)
        table = find_loader(s.name, registry)(spark, root, options)
        for key in options:
            raise SpecError(f"stream source {s.name!r} takes no option {key!r}")
        frames.append(read_stream(spark, table, files_per_trigger))
    return frames, sources


def concat_streams(streams: list[DataFrame], out: str, checkpoint: str, order_in_batch: str) -> None:
    """Streams one after another.  Each is read until nothing is left
    before the next one starts; ``position`` counts on within a source from
    batch to batch, and from source to source.  The rows of each batch are
    recorded with the batch, and a source that is used up with its total, so a
    job that is started again goes on where the last one stopped, in the middle
    of any source."""
    spark, base = streams[0].sparkSession, 0
    for k, stream in enumerate(streams):
        place = f"{checkpoint.rstrip('/')}/source={k}"
        done = f"{place}_done"
        if not _exists(spark, done):
            counts = f"{place}_counts"

            def each(batch: DataFrame, batch_id: int, k=k, base=base, counts=counts) -> None:
                before = _carried(batch.sparkSession, counts, batch_id, "n long").first()
                before = before["n"] if before else 0
                rows = global_rank(batch, F.col(order_in_batch), F.col(order_in_batch), out="position")
                rows = rows.withColumn("position", F.col("position") + F.lit(base + before))
                rows.write.mode("overwrite").parquet(f"{out}/source_rank={k}/batch_id={batch_id}")
                n = batch.sparkSession.read.parquet(f"{out}/source_rank={k}/batch_id={batch_id}").count()
                batch.sparkSession.createDataFrame([(before + n,)], "n long").write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

            run_batches(stream, each, f"{place}_stream")
            total = 0
            if _exists(spark, counts):
                total = spark.read.parquet(counts).agg(F.max("n")).first()[0] or 0
            spark.createDataFrame([(total,)], "n long").write.mode("overwrite").parquet(done)
        base += spark.read.parquet(done).first()["n"]


def stream_take(df: DataFrame, n: int) -> DataFrame:
    """Take the first n rows of a stream (append mode)."""
    return df.limit(n)


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over everything available now into a parquet sink."""
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(df: DataFrame, each, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over everything available now through ``foreachBatch``."""
    q = (df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def _carried(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """The table that the batch before left (empty before the first)."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch_id - 1}")


def pack_per_batch(df: DataFrame, out: str, checkpoint: str, seq_length: int, key: str = "doc_id",
                   eos_id: int | None = None, group_size: int = 1000) -> None:
    """T2, reference shape: every micro-batch is packed on its own, in groups
    of ``group_size`` rows in key order, whose incomplete tails are dropped."""
    def each(batch: DataFrame, batch_id: int) -> None:
        (pk.pack(batch, seq_length, key=key, eos_id=eos_id, group_size=group_size)
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    run_batches(df, each, checkpoint)


def pack_lanes(df: DataFrame, out: str, checkpoint: str, seq_length: int, lane: str = "lane", key: str = "doc_id",
               ids: str = "input_ids", eos_id: int | None = None) -> None:
    """T2 exact: chunks ``(lane, chunk_id, input_ids, labels)``, written once by
    the file sink; what a lane has left over is in the state store.  The
    number of lanes, and so of tasks, is the caller's: any number of keys in
    ``lane`` will do."""
    if eos_id is not None:
        from tidepool.operators.tokens import append_eos
        df = append_eos(df, eos_id, ids)
    with state_store(df.sparkSession):
        run_to_parquet(lane_chunks(df, seq_length, lane, key, ids), out, checkpoint)


def interval_metrics(df: DataFrame, metrics: Metrics, out: str, checkpoint: str, **columns) -> None:
    """G4 on a stream: the states of the intervals that each micro-batch
    touches (``interval_states``), written in update mode."""
    with state_store(df.sparkSession):
        write_updates(interval_states(df, metrics, **columns), out, checkpoint)


COUNTS = "source_rank int, n long"


def split_stream(df: DataFrame, sources: list[Source], out: str, checkpoint: str, order_in_batch: str) -> None:
    """L4 on a stream (offset and sort are not allowed on streams): of each
    source, the first ``test`` rows are ``test`` and the next ``train`` rows
    ``train``; without limits all its rows are ``train``.  A source's rows are
    counted on from batch to batch; the counts are one row a source."""
    counts = checkpoint.rstrip("/") + "_counts"
    for s in sources:
        for name in s.limits.keys() - {"train", "test"}:
            raise SpecError(f"stream source {s.name!r}: only train and test can be limited, not {name!r}")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {r.source_rank: r.n for r in _carried(spark, counts, batch_id, COUNTS).collect()}
        now = {r["source_rank"]: r["count"] for r in batch.groupBy("source_rank").count().collect()}
        parts = []
        for rank, s in enumerate(sources):
            rows = batch.where(F.col("source_rank") == rank)
            rows = global_rank(rows, F.col(order_in_batch), F.col(order_in_batch), out="position")
            rows = rows.withColumn("position", F.col("position") + F.lit(before.get(rank, 0)))
            test, train = s.limits.get("test", 0), s.limits.get("train")
            if s.limits:
                rows = rows.where(F.col("position") < test + (train or 0))
            parts.append(rows.withColumn("split", F.when(F.col("position") < test, "test").otherwise("train")))
        res = parts[0]
        for p in parts[1:]:
            res = res.unionByName(p)
        res.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        total = [(k, before.get(k, 0) + now.get(k, 0)) for k in range(len(sources))]
        spark.createDataFrame(total, COUNTS).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

    run_batches(df, each, checkpoint)


def write_audited(df: DataFrame, checks: dict, out: str, checkpoint: str) -> DataFrame:
    """Writes the rows without a reject reason, and for each micro-batch the
    counts of its own reasons, from the scan that writes the rows.  A batch that
    runs again replaces both.  Returns ``(reason, n)`` over all batches."""
    counts = checkpoint.rstrip("/") + "_reasons"

    def each(batch: DataFrame, batch_id: int) -> None:
        audit = Audit(checks)
        audit.kept(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        audit.report(batch).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch_id={batch_id}")

    run_batches(df, each, checkpoint)
    return df.sparkSession.read.parquet(counts).groupBy("reason").agg(F.sum("n").alias("n"))


def running_metrics(df: DataFrame, run: str, split: str, value: str, weight: str) -> DataFrame:
    """T4: running weighted mean per (run, split) as a streaming
    aggregation (partial aggregation per micro-batch, state per key)."""
    return (df.groupBy(run, split)
            .agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"),
                 F.sum(weight).alias("weight")))


def write_updates(agg: DataFrame, out: str, checkpoint: str) -> None:
    """Write the keys that each micro-batch changed, in update mode."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_batches(agg, each, checkpoint, "update")


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "batch_id"))), "batch_id").alias("_r")
    return rows.groupBy(*keys).agg(last).select(*keys, "_r.*")
