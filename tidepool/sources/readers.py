"""Batch sources and sinks.

Everything is a plain ``spark.read`` / ``df.write``: split and config are
partition columns so Catalyst prunes partitions and pushes filters into the
parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, config: str | None = None,
               split: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read one dataset, optionally one config and one split.  ``config``
    and ``split`` are partition directories, so the filters prune files."""
    df = spark.read.format(fmt).load(path)
    if config is not None:
        if "config" not in df.columns:
            raise ValueError(f"{path} has no config partitions")
        df = df.where(F.col("config") == config)
    if split is not None and "split" in df.columns:
        df = df.where(F.col("split") == split)
    return df


def read_all_configs(spark: SparkSession, path: str, normaliser=None,
                     config: str | None = None) -> DataFrame:
    """Load every config of a source in one scan (partition discovery
    recovers ``config``), or one named config; error when none exist."""
    df = spark.read.parquet(path)
    if "config" not in df.columns:
        raise ValueError(f"{path} is not partitioned by config")
    if config is not None:
        df = df.where(F.col("config") == config)
    return normaliser(df) if normaliser else df


def prepared_path(base: str, params: dict | None = None) -> str:
    """The parameter-tagged output folder of a prepared corpus,
    e.g. ``base/max_length-1024-insert_eos-True-drop_tail-True``."""
    if not params:
        return base
    tag = "-".join(f"{k}-{v}" for k, v in params.items())
    return f"{base.rstrip('/')}/{tag}"


def write_prepared(df: DataFrame, path: str, params: dict | None = None,
                   mode: str = "overwrite") -> str:
    """Write prepared data partitioned by split (and config when present)."""
    out = prepared_path(path, params)
    parts = [c for c in ("split", "config") if c in df.columns]
    if parts:
        # rows of a partition meet before the write; AQE splits what is large
        df.hint("rebalance", *(F.col(c) for c in parts)).write.mode(mode).partitionBy(*parts).parquet(out)
    else:
        df.write.mode(mode).parquet(out)
    return out


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Reload prepared (tokenised) data; normalisers are skipped."""
    return spark.read.parquet(path)


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Every ``*/results.json`` under a run folder as a long table
    ``(path, task, metric, text, value)``.

    Metric values are read as text, since files hold names and ``"N/A"`` beside
    the numbers; ``value`` is null for what is not a number.  A task without
    metrics keeps one row with a null metric; a file that cannot be read keeps
    one row with a null task, so nothing is lost silently."""
    raw = spark.read.option("wholetext", True).text(pattern).withColumn("path", F.input_file_name())
    results = F.from_json("value", "results map<string, map<string, string>>")["results"]
    tasks = raw.select("path", F.explode_outer(results).alias("task", "metrics"))
    metrics = tasks.select("path", "task", F.explode_outer("metrics").alias("metric", "text"))
    return metrics.withColumn("value", F.col("text").try_cast("double"))


def unreadable_results(results: DataFrame) -> DataFrame:
    """The files among ``read_results`` that hold no task."""
    return results.where("task is null").select("path")


def write_results(df: DataFrame, base: str, run_col: str = "run", task_col: str = "task",
                  metric_col: str = "metric", value_col: str = "value") -> str:
    """Write ``<run>/results.json`` for each run of a long metric table; a
    task whose metric is null gets an empty map, and values may be numbers or
    text.  The JSON text is built and written by Spark, one file a run; only
    the files' names pass through the driver."""
    entry = F.when(F.col(metric_col).isNotNull(), F.struct(F.col(metric_col), F.col(value_col)))
    per_task = df.groupBy(run_col, task_col).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    per_run = (per_task.groupBy(run_col)
               .agg(F.map_from_entries(F.collect_list(F.struct(task_col, "m"))).alias("results")))
    out = per_run.select(F.col(run_col).cast("string").alias("run"), F.to_json(F.struct("results")).alias("value"))
    out.repartition("run").write.mode("overwrite").partitionBy("run").text(base)
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/run=*/part-*")):
        files.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(part.getPath().getParent(), "results.json"))
    return base


def append_run_log(df: DataFrame, path: str, key: str = "key", txn: tuple[str, ...] = ("job",)) -> None:
    """Add rows to a log table that is partitioned by the columns of a
    transaction (the job, or run and step) and by ``key``, of which there are
    few (metric names, kinds of log).  The partitions that the rows belong to
    are written as a whole, so the same transaction written again, by a job that
    was retried, replaces itself and adds nothing; others stay as they are."""
    missing = [c for c in (*txn, key) if c not in df.columns]
    if missing or not txn:
        raise ValueError(f"a log needs its transaction and key columns; {missing} not found")
    df.repartition(*txn, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*txn, key).parquet(path)


GENERATIONS = ("run", "step", "prompt", "generation")


def log_generations(df: DataFrame, path: str) -> None:
    """Prompts with what was generated for them at a step of a run."""
    append_run_log(df.select(*GENERATIONS, F.lit("generations").alias("key")), path, txn=("run", "step"))
