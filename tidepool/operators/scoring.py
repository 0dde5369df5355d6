"""Aggregations over scored tokens, run logs and evaluation outputs
(G1–G7, G9, W1, W2, L7).

Hot keys: a run (or any partition key) may hold a large share of the rows.
Running counts and lags therefore use a two-level plan — a window inside
(key, time bucket), buckets being bounded in rows, plus a small per-bucket
table carried across buckets — instead of one window over the whole key.  Per-sequence work (top-k, token
sums) stays inside the row as array expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.rand import drawn, once, stem, uniform
from tidepool.operators.metric_state import Metrics
from tidepool.session import scratch_path

IGNORE = -100


# ------------------------------------------------------------ token scores

def pseudo_token_nll(seed, key: Column, n: Column) -> Column:
    """Deterministic stand-in for model token NLLs: -ln(1 - U) per position
    (exponential with mean 1); the model's real scores arrive as a table
    with the same shape."""
    return once({"stem": stem(seed, F.lit("nll"), key)}, lambda r: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: -F.log(F.lit(1.0) - drawn(r["stem"], i))))


def weighted_token_values(df: DataFrame, nll: str = "token_nll", weight: str = "loss_weight",
                          masked: str = "masked", labels: str = "labels") -> DataFrame:
    """Per row, the quantities that the G-metrics need: ``row_value``, the
    weighted NLL of all masked positions (the loss, G3); ``row_nll``, that of
    the masked positions with a label (the metric, G1); ``row_eligible``, the
    number of positions with a label.  Suffix and curriculum masks also cover
    positions without one, so the two sums differ."""
    at = F.transform(F.arrays_zip(F.col(nll).alias("v"), F.col(masked).alias("m"), F.col(labels).alias("y")), lambda p: F.struct(
        F.when(p["m"], p["v"]).otherwise(F.lit(0.0)).alias("v"), (p["y"] != F.lit(IGNORE)).alias("e")))
    df = df.withColumn("_at", at)
    total = lambda only: F.aggregate("_at", F.lit(0.0), lambda a, p: a + (F.when(p["e"], p["v"]).otherwise(F.lit(0.0)) if only else p["v"]))
    return (df.withColumn("row_value", total(False) * F.col(weight)).withColumn("row_nll", total(True) * F.col(weight))
            .withColumn("row_eligible", F.size(F.filter("_at", lambda p: p["e"])).cast("bigint")).drop("_at"))


def nll_by_split(df: DataFrame, split: str = "split") -> DataFrame:
    """G1 + G2: weighted mean NLL per split (denominator: all eligible
    tokens, masked or not) and perplexity = exp(mean NLL).  Partial + final
    aggregation; no group is collected."""
    return (df.groupBy(split)
            .agg(F.sum("row_nll").alias("_v"), F.sum("row_eligible").alias("n_eligible"))
            .select(split, (F.col("_v") / F.col("n_eligible")).alias("nll"),
                    F.exp(F.col("_v") / F.col("n_eligible")).alias("ppl"), "n_eligible"))


def normalise_loss(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch — token: Σvalue / max(1, Σeligible); sequence:
    Σ_rows (value / max(1, eligible_row)) / b; batch: Σvalue / b."""
    per_row = F.col("row_value") / F.greatest(F.col("row_eligible"), F.lit(1))
    return (df.groupBy(batch).agg(
        (F.sum("row_value") / F.greatest(F.sum("row_eligible"), F.lit(1))).alias("loss_token"),
        (F.sum(per_row) / F.count(F.lit(1))).alias("loss_sequence"),
        (F.sum("row_value") / F.count(F.lit(1))).alias("loss_batch"),
        F.count(F.lit(1)).alias("batch_rows")))


# ------------------------------------------------ hot-key-safe windows

#: Spans of time, in microseconds, each a whole number of the next.
SPANS = (3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def time_buckets(df: DataFrame, time: Column, tiebreak: str, run: str, rows: int = 100_000, out: str = "bucket") -> DataFrame:
    """Adds a bucket that grows with ``time`` (integral microseconds), such
    that a run has at most about ``rows`` rows in one: an hour, or where a run
    logs more in it a minute of that hour, and so on; rows of one run and one
    microsecond are told apart by the tiebreak.  Each span takes one
    aggregation over the rows that the span before left too full, and most logs
    stop after the first."""
    df = df.withColumn("_time", time.cast("long"))
    start = lambda span: F.col("_time") - F.pmod(F.col("_time"), F.lit(span))
    level, full = F.lit(0), None
    for k, span in enumerate(SPANS):
        part = df if full is None else df.join(full, ["_run", "_start"], "left_semi")
        part = part.withColumn("_run", F.col(run)).withColumn("_start", start(span))
        counts = part.where("_run is not null and _time is not null").groupBy("_run", "_start").count().where(F.col("count") > rows).drop("count")
        full = saved_keys(counts)
        if full is None:
            break
        mark = full.withColumn(f"_l{k}", F.lit(1))
        df = (df.withColumn("_run", F.col(run)).withColumn("_start", start(span)).join(mark, ["_run", "_start"], "left"))
        level = level + F.coalesce(F.col(f"_l{k}"), F.lit(0))
        df = df.withColumn("_level", level)
    if "_level" not in df.columns:
        return df.withColumn(out, F.struct(start(SPANS[0]).alias("start"), F.lit(0).cast("long").alias("part"))).drop("_time")
    begin = F.coalesce(*(F.when(F.col("_level") == k, start(span)) for k, span in enumerate(SPANS)), F.col("_time"))
    part = F.when(F.col("_level") == len(SPANS), F.call_function("div", F.col(tiebreak).cast("long"), F.lit(rows))).otherwise(F.lit(0).cast("long"))
    extra = [c for c in df.columns if c in ("_run", "_start", "_level", "_time") or re.fullmatch(r"_l\d", c)]
    return df.withColumn(out, F.struct(begin.alias("start"), part.alias("part"))).drop(*extra)


def saved_keys(counts: DataFrame) -> DataFrame | None:
    """The groups that are too full, written to the checkpoint folder (at most
    one for every ``rows`` rows of the log); None if there is none."""
    path = scratch_path(counts.sparkSession, "full")
    counts.write.parquet(path)
    kept = counts.sparkSession.read.schema(counts.schema).parquet(path)
    return None if kept.isEmpty() else kept


def running_count(df: DataFrame, key: str, order: list[str], flag: Column, bucket: Column,
                  out: str = "running", inclusive: bool = False) -> DataFrame:
    """Running count of ``flag`` per ``key`` in ``order``, computed as
    (count in earlier buckets of the key) + (count earlier in the bucket).
    The only full window runs per (key, bucket); the carried table has one
    row per (key, bucket)."""
    d = df.withColumn("_bk", bucket).withColumn("_f", flag.cast("long"))
    frame = (Window.partitionBy(key, "_bk").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    d = d.withColumn("_in", F.coalesce(F.sum("_f").over(frame), F.lit(0)))
    per = d.groupBy(key, "_bk").agg(F.sum("_f").alias("_cnt"))
    carry = per.withColumn("_before", F.coalesce(F.sum("_cnt").over(
        Window.partitionBy(key).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (_same_bucket(d, carry, key, "_before")
            .withColumn(out, F.col("_before") + F.col("_in"))
            .drop("_bk", "_f", "_in", "_before"))


def _same_bucket(d: DataFrame, carried: DataFrame, key: str, col: str) -> DataFrame:
    """``d`` with the carried value of its (key, bucket); a null key or
    bucket is a key like others."""
    c = carried.select(F.col(key).alias("_key"), F.col("_bk").alias("_cbk"), col)
    return d.join(c, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bk").eqNullSafe(F.col("_cbk"))).drop("_key", "_cbk")


def bucketed_lag(df: DataFrame, key: str, order: list[str], cols: list[str], bucket: Column,
                 prefix: str = "prev_") -> DataFrame:
    """``lag(col)`` over (key ORDER BY order) without a whole-key window:
    lag inside (key, bucket), and for a bucket's first row the last row of
    the key's previous non-empty bucket."""
    d = df.withColumn("_bk", bucket)
    w = Window.partitionBy(key, "_bk").orderBy(*order)
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    d = d.withColumn("_first", F.row_number().over(w) == 1)
    last = d.groupBy(key, "_bk").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    lastp = last.withColumn("_plast", F.lag("_last").over(Window.partitionBy(key).orderBy("_bk")))
    d = _same_bucket(d, lastp, key, "_plast")
    for c in cols:
        d = d.withColumn(prefix + c, F.when(F.col("_first"), F.col("_plast")[c]).otherwise(F.col(prefix + c)))
    return d.drop("_bk", "_first", "_plast")


def as_of(df: DataFrame, settings: DataFrame, run: str, time: str, tiebreak: str, cols: list[str], rows: int = 100_000) -> DataFrame:
    """``df`` with the settings ``cols`` that held for its run at its time:
    those of the last row of ``settings`` that is not later (one with the same
    time and tiebreak counts), null before the first.  Adds ``bucket``, as the
    other windows need it.  A run's rows are never in one window: settings are
    looked up within a bucket, and the last ones of each bucket carried on."""
    here = df.select("*", F.lit(1).alias("_is_row"), *(F.lit(None).cast(settings.schema[c].dataType).alias(c) for c in cols))
    given = settings.select(run, time, tiebreak, F.lit(0).alias("_is_row"), *cols)
    both = time_buckets(here.unionByName(given, allowMissingColumns=True), F.col(time), tiebreak, run, rows)
    both = both.withColumn("_set", F.when(F.col("_is_row") == 0, F.struct(*cols)))
    order = [time, tiebreak, "_is_row"]
    w = Window.partitionBy(run, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_now", F.last("_set", ignorenulls=True).over(w)).withColumn("_bk", F.col("bucket"))
    last = both.groupBy(run, "_bk").agg(F.max_by("_set", F.when(F.col("_set").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(run).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.last("_end", ignorenulls=True).over(before))
    found = _same_bucket(both.where("_is_row = 1").drop(*cols), last, run, "_before").withColumn("_now", F.coalesce("_now", "_before"))
    return found.select("*", *(F.col("_now")[c].alias(c) for c in cols)).drop("_now", "_before", "_set", "_is_row", "_bk")


# --------------------------------------------------------- G4 intervals

def metrics_by_interval(df: DataFrame, run: str, order: list[str], is_mark: Column, split: Column,
                        metrics: Metrics, bucket: Column) -> DataFrame:
    """Metric state is reset at every evaluation mark, so a value covers
    the interval since the previous mark: the states of each (run, interval,
    split), where interval = running count of marks (hot-run safe), finished
    and with their names in the log."""
    d = running_count(df, run, order, is_mark, bucket, out="eval_interval", inclusive=True)
    return metrics.logged(metrics.states(d.where(~F.coalesce(is_mark, F.lit(False))), run, "eval_interval", split.alias("split")))


# ------------------------------------------------------------- W1 throughput

def throughput(df: DataFrame, run: str, step: str, ts: str, run_start: Column, global_batch: Column,
               bucket: Column) -> DataFrame:
    """steps/s and samples/s between consecutive log rows of a run.
    Rows with step 0 are ignored; the first interval starts at the run's
    start with step 0; no row when Δt <= 0 or Δstep <= 0."""
    d = df.where(F.col(step) != 0)
    d = bucketed_lag(d, run, [ts, step], [ts, step], bucket)
    pt = F.coalesce(F.col("prev_" + ts), run_start)
    ps = F.coalesce(F.col("prev_" + step), F.lit(0))
    dt = F.col(ts).cast("double") - pt.cast("double")
    ds = (F.col(step) - ps).cast("double")
    sps = ds / dt
    return (d.where((dt > 0) & (ds > 0))
            .withColumn("steps_per_sec", sps)
            .withColumn("samples_per_sec", sps * global_batch))


# ------------------------------------------------------- G5 / G7 likelihood

def mc_loglikelihood(df: DataFrame, request: str = "item_id", loop: str = "loop",
                     copy_value: str = "copy_value", batch: int = 8) -> DataFrame:
    """Per loop ``Σ_copies Σ_masked nll/p / batch``; log-likelihood =
    ``-mean over loops``."""
    per_loop = df.groupBy(request, loop).agg((F.sum(copy_value) / F.lit(float(batch))).alias("_l"))
    return per_loop.groupBy(request).agg((-F.avg("_l")).alias("loglikelihood"),
                                         F.count(F.lit(1)).alias("n_loops"))


def exact_match(target: Column, prediction: Column, enabled: bool = False) -> Column:
    """Greedy match (all target tokens equal the prediction); disabled
    by default, as in the reference, where it is constant false."""
    if not enabled:
        return F.lit(False)
    return (F.size(target) == F.size(prediction)) & F.coalesce(
        F.forall(F.arrays_zip(target.alias("a"), prediction.alias("b")), lambda p: p["a"] == p["b"]), F.lit(True))


# --------------------------------------------------------- G6 score summary

# Metric names tried in order by the score summary.
SUMMARY_METRICS = ("acc,none", "em,none", "acc_norm,none")


def score_summary(results: DataFrame, compat: bool = False) -> DataFrame:
    """Per (file, task) the first metric of ``acc,none``, ``em,none``,
    ``acc_norm,none``.  The reference takes the first *truthy* one (a real
    0.0 falls through) — ``compat=True``; default takes the first present.
    Missing everywhere -> 'N/A'."""
    wide = (results.groupBy("path", "task")
            .agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"m{i}")
                   for i, m in enumerate(SUMMARY_METRICS)]))
    cols = [F.col(f"m{i}") for i in range(len(SUMMARY_METRICS))]
    if compat:
        cols = [F.when(c != 0, c) for c in cols]
    score = F.coalesce(*cols)
    return wide.select("path", "task", F.coalesce(score.cast("string"), F.lit("N/A")).alias("score"),
                       score.alias("score_value"))


# ------------------------------------------------------------ G9 histories

def finished_block(blocks: Column, eos_id: int) -> Column:
    """G9 per sequence: index of the first block holding EOS (NULL if none)."""
    idx = F.transform(blocks, lambda b, i: F.when(F.array_contains(b, F.lit(eos_id)), i))
    return F.get(F.filter(idx, lambda v: v.isNotNull()), 0)


# ----------------------------------------------------------------- L7 top-k

def topk_positions(conf: Column, masked: Column, k: Column) -> Column:
    """Positions of the k highest-confidence masked positions (non-masked
    count as -inf and are never chosen; k capped by the number available);
    the lower position wins ties."""
    cand = F.filter(F.zip_with(conf, masked, lambda c, m: F.struct(c.alias("c"), m.alias("m"))),
                    lambda s: s["m"])
    idx = F.filter(F.transform(F.zip_with(conf, masked, lambda c, m: F.struct(c.alias("c"), m.alias("m"))),
                               lambda s, i: F.when(s["m"], F.struct((-s["c"]).alias("nc"), i.alias("pos")))),
                   lambda v: v.isNotNull())
    ordered = F.array_sort(idx)
    kk = F.least(k, F.size(cand))
    return F.transform(F.slice(ordered, 1, kk), lambda s: s["pos"])
