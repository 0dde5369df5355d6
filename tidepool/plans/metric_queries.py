"""Metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions.rand import hash52, sql_hash52, sql_uniform
from tidepool.functions.schedules import loss_weight, reverse_transfer
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import batching as bt, metric_state as ms, noise as nz, scoring as sc, split as sp
from tidepool.plans.chat_queries import sql_split
from tidepool.plans.noise_queries import MASK, SQL_BASE, _sql_u, noised_base
from tidepool.plans.registry import register
from tidepool.plans.sequence_queries import SQL_DOCS, encoded_docs, sql_md5_ids
from tidepool.session import scratch_path
from tidepool.sources.readers import table


#: Microseconds of a wall-clock (NTZ) time: no session time zone involved.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"


def run_log(spark, sf_dir):
    """The events with a time bucket of bounded rows."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return sc.time_buckets(e, F.expr(MICROS), "event_id", "user_id")


def scored_rows(spark, sf_dir, strategy="random"):
    d = nz.apply_mask(noised_base(spark, sf_dir), MASK, strategy, seed=2)
    d = d.withColumn("token_nll", sc.pseudo_token_nll(12, F.col("doc_id"), F.size("input_ids")))
    d = d.withColumn("loss_weight", loss_weight(F.col("t"), "linear", "alpha"))
    return sc.weighted_token_values(d)


SQL_SCORED = f"""{SQL_BASE},
m AS (SELECT doc_id, t, ids, labels,
             list_transform(ids, lambda x, i: {_sql_u('m', 'i - 1')} < p AND labels[i] <> -100) AS masked FROM pm),
sc AS (
  SELECT doc_id,
    coalesce(list_sum(list_transform(range(len(ids)), lambda i: CASE WHEN masked[i + 1]
        THEN -ln(1.0 - {sql_uniform(12, "'nll'", 'doc_id', 'i')}) ELSE 0.0 END)), 0.0)
      * (1.0 / ((1.0 - (1.0 - t)) + 1e-6)) AS row_value,
    len(list_filter(labels, lambda y: y <> -100))::BIGINT AS row_eligible
  FROM m
)"""


# --------------------------------------------------------- G1, G2

def loss_metrics_split(spark, sf_dir):
    d = scored_rows(spark, sf_dir)
    d = sp.split_exact(d, "doc_id", 0.05, seed=42)
    d = d.withColumn("split", F.when(F.col("split") == "test", "eval").otherwise("train"))
    r = sc.nll_by_split(d)
    return r.select("split", F.round("nll", 6).alias("nll"), F.round("ppl", 6).alias("ppl"), "n_eligible")


register("loss_metrics_split", f"""
WITH {SQL_SCORED},
s AS (SELECT *, CASE WHEN {sql_split('doc_id')} = 'test' THEN 'eval' ELSE 'train' END AS split FROM sc)
SELECT split, round(sum(row_value) / sum(row_eligible), 6) AS nll,
       round(exp(sum(row_value) / sum(row_eligible)), 6) AS ppl, sum(row_eligible)::BIGINT AS n_eligible
FROM s GROUP BY split
""")(loss_metrics_split)


def loss_metrics_suffix(spark, sf_dir):
    """G1, G2 under suffix masks, which also cover positions without a label:
    those count in the loss (G3) and not in the metric."""
    r = sc.nll_by_split(scored_rows(spark, sf_dir, "truncated_suffix").withColumn("split", F.col("lang")))
    return r.select("split", F.round("nll", 6).alias("nll"), F.round("ppl", 6).alias("ppl"), "n_eligible")


register("loss_metrics_suffix", f"""
WITH {SQL_BASE.replace("SELECT doc_id, ids, list_transform(ids", "SELECT doc_id, lang, ids, list_transform(ids")},
c AS (SELECT *, floor(len(ids) * ({sql_uniform(2, "'suffix'", 'doc_id')} * 0.3))::INTEGER AS cut FROM pm),
m AS (SELECT *, list_transform(ids, lambda x, i: (cut > 0 AND i - 1 >= len(ids) - cut) OR ({_sql_u('m', 'i - 1')} < p AND labels[i] <> -100)) AS masked FROM c),
s AS (SELECT lang AS split, len(list_filter(labels, lambda y: y <> -100)) AS n,
        coalesce(list_sum(list_transform(range(len(ids)), lambda i: CASE WHEN masked[i + 1] AND labels[i + 1] <> -100
          THEN -ln(1.0 - {sql_uniform(12, "'nll'", 'doc_id', 'i')}) ELSE 0.0 END)), 0.0) * (1.0 / ((1.0 - (1.0 - t)) + 1e-6)) AS v FROM m)
SELECT split, round(sum(v) / sum(n), 6) AS nll, round(exp(sum(v) / sum(n)), 6) AS ppl, sum(n)::BIGINT AS n_eligible FROM s GROUP BY split
""")(loss_metrics_suffix)


# ----------------------------------------------------------- G3

def loss_norm_batches(spark, sf_dir):
    d = bt.assign_batches(scored_rows(spark, sf_dir), 8, hash52(13, F.col("doc_id")), "doc_id")
    r = sc.normalise_loss(d)
    return r.select("batch_id", *[F.round(c, 6).alias(c) for c in ("loss_token", "loss_sequence", "loss_batch")],
                    F.col("batch_rows").cast("bigint").alias("batch_rows"))


register("loss_norm_batches", f"""
WITH {SQL_SCORED},
b AS (SELECT *, (row_number() OVER (ORDER BY {sql_hash52(13, 'doc_id')}, doc_id) - 1) // 8 AS batch_id FROM sc)
SELECT batch_id::BIGINT AS batch_id,
       round(sum(row_value) / greatest(sum(row_eligible), 1), 6) AS loss_token,
       round(sum(row_value / greatest(row_eligible, 1)) / count(*), 6) AS loss_sequence,
       round(sum(row_value) / count(*), 6) AS loss_batch, count(*)::BIGINT AS batch_rows
FROM b GROUP BY batch_id
""")(loss_norm_batches)


# ----------------------------------------------------- G4 + W2 on the run log

def metrics_interval_events(spark, sf_dir):
    e = run_log(spark, sf_dir)
    mark = F.col("event_type") == "signup"
    split = F.when(F.col("event_type") == "error", F.lit("eval")).otherwise(F.lit("train"))
    r = sc.metrics_by_interval(e, "user_id", ["ts", "event_id"], mark, split, ms.Metrics({"loss": ms.Metric(F.col("value"))}), F.col("bucket"))
    return r.select("user_id", F.col("eval_interval").cast("bigint").alias("eval_interval"), "split", "key",
                    F.round("value", 6).alias("value"))


register("metrics_interval_events", """
WITH r AS (
  SELECT *, count(*) FILTER (WHERE event_type = 'signup')
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS eval_interval,
         CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS split
  FROM events
)
SELECT user_id, eval_interval::BIGINT AS eval_interval, split,
       CASE WHEN split = 'train' THEN 'loss' ELSE split || '_loss' END AS key, round(avg(value), 6) AS value
FROM r WHERE event_type <> 'signup' GROUP BY user_id, eval_interval, split
""")(metrics_interval_events)


# -------------------------------------- G4 collections, merged in two levels

def run_metrics() -> ms.Metrics:
    """The metrics of the run log; a value stands for a thousandth of a nat."""
    return ms.Metrics({"loss": ms.Metric(F.col("value")),
                       "ppl": ms.Metric(F.col("value") / 1000, finish=ms.perplexity),
                       "weighted": ms.Metric(F.col("value"), 1 + F.col("event_id") % 3)})


def metric_rollup_events(spark, sf_dir):
    """States of each (run, day, split), kept by day as a job of each day would
    leave them, rolled up to runs and from there to splits."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    e = e.withColumn("split", F.when(F.col("event_type") == "error", F.lit("eval")).otherwise(F.lit("train")))
    m, path = run_metrics(), scratch_path(spark, "states")
    daily = m.states(e, "user_id", "day", "split")
    for part, rows in (("early", "day < DATE'2024-01-11'"), ("late", "day >= DATE'2024-01-11'"), ("late", "day >= DATE'2024-01-11'")):
        ms.save_states(daily.where(rows), path, part)  # the second job ran twice
    runs = m.merge(spark.read.parquet(path).drop("part"), "user_id", "split")
    whole = m.merge(runs, "split").withColumn("user_id", F.lit(None).cast("long"))
    out = m.logged(runs.unionByName(whole))
    return out.select("user_id", "key", "rows", F.round("value", 9).alias("value"))


register("metric_rollup_events", """
WITH r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'eval_' ELSE '' END AS pre FROM events),
g AS (SELECT user_id, pre, count(value)::BIGINT AS rows, avg(value) AS m,
        sum(value * (1 + event_id % 3)) / sum(CASE WHEN value IS NOT NULL THEN 1 + event_id % 3 END) AS w
      FROM r GROUP BY GROUPING SETS ((user_id, pre), (pre)))
SELECT user_id, pre || 'loss' AS key, rows, round(m, 9) AS value FROM g WHERE rows > 0
UNION ALL SELECT user_id, pre || 'ppl', rows, round(exp(m / 1000), 9) FROM g WHERE rows > 0
UNION ALL SELECT user_id, pre || 'weighted', rows, round(w, 9) FROM g WHERE rows > 0
""")(metric_rollup_events)


# ----------------------------------------------------------------- W1

def throughput_events(spark, sf_dir):
    """Batch settings change during a run: a purchase sets the rows a device
    takes, a click the accumulation; they hold until the next."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").withColumn("at", F.expr(MICROS))
    given = e.where(F.col("event_type").isin("purchase", "view")).select(
        "user_id", "at", "event_id", (1 + F.col("event_id") % 8).alias("per_device"), F.when(F.col("event_type") == "view", 2).otherwise(4).alias("accumulation"))
    e = sc.as_of(e, given, "user_id", "at", "event_id", ["per_device", "accumulation"]).withColumn("t_sec", F.col("at") / 1e6)
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                   "TIMESTAMP_NTZ'2024-01-01 00:00:00')") / 1e6
    batch = F.coalesce("per_device", F.lit(8)) * F.coalesce("accumulation", F.lit(4)) * 2
    r = sc.throughput(e, "user_id", "event_id", "t_sec", start, batch, F.col("bucket"))
    return r.select("user_id", "event_id", "per_device", F.round("steps_per_sec", 6).alias("steps_per_sec"),
                    F.round("samples_per_sec", 6).alias("samples_per_sec"))


register("throughput_events", """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t,
             last_value(CASE WHEN event_type IN ('purchase', 'view') THEN 1 + event_id % 8 END IGNORE NULLS) OVER r AS per_device,
             last_value(CASE WHEN event_type = 'view' THEN 2 WHEN event_type = 'purchase' THEN 4 END IGNORE NULLS) OVER r AS accumulation
           FROM events WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, coalesce(lag(t) OVER w, epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 1e6) AS pt,
             coalesce(lag(event_id) OVER w, 0) AS ps
      FROM e WHERE event_id <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, per_device::BIGINT AS per_device, round((event_id - ps)::DOUBLE / (t - pt), 6) AS steps_per_sec,
       round((event_id - ps)::DOUBLE / (t - pt) * (coalesce(per_device, 8) * coalesce(accumulation, 4) * 2), 6) AS samples_per_sec
FROM l WHERE t - pt > 0 AND event_id - ps > 0
""")(throughput_events)


# -------------------------------------------------------- G5 + G7

def mc_loglik_bench(spark, sf_dir):
    from tidepool.plans.noise_queries import bench_requests
    r = bench_requests(spark, sf_dir).where(F.col("target_len") > 0)
    m = nz.mc_perturb(r, "item_id", "target_len", mc_num=128, batch=8, seed=6)
    nll = sc.pseudo_token_nll(14, F.col("item_id"), F.col("target_len"))
    m = m.withColumn("copy_value", F.aggregate(
        F.zip_with(nll, F.col("target_mask"), lambda v, k: F.when(k, v).otherwise(F.lit(0.0))),
        F.lit(0.0), lambda a, v: a + v) / F.col("p"))
    ll = sc.mc_loglikelihood(m, batch=8)
    tgt = r.select("item_id", TOK.encode(F.col("continuation")).alias("tgt"))
    pred = F.transform("tgt", lambda x, i: F.when(
        sc.uniform(15, F.lit("pred"), F.col("item_id"), i) < 0.05, x + 1).otherwise(x))
    g = tgt.select("item_id", sc.exact_match(F.col("tgt"), pred, enabled=True).cast("int").alias("is_greedy"))
    return ll.join(g, "item_id").select("item_id", F.round("loglikelihood", 6).alias("loglikelihood"),
                                        F.col("n_loops").cast("bigint").alias("n_loops"), "is_greedy")


def _sql_mc_ll() -> str:
    from tidepool.plans.noise_queries import sql_mc_copies
    cont = "substr(text, length(split_part(text, '.', 1)) + 1)"
    nll = f"-ln(1.0 - {sql_uniform(14, chr(39) + 'nll' + chr(39), 'item_id', 'q')})"
    pred_diff = f"{sql_uniform(15, chr(39) + 'pred' + chr(39), 'item_id', 'q')} < 0.05"
    return f"""
WITH {sql_mc_copies(cont)},
v AS (SELECT item_id, loop, coalesce(list_sum(list_transform(range(L), lambda q:
         CASE WHEN dr[q + 1] < x THEN {nll} ELSE 0.0 END)), 0.0) / (x / L) AS cv FROM d),
lo AS (SELECT item_id, loop, sum(cv) / 8.0 AS lv FROM v GROUP BY item_id, loop),
ll AS (SELECT item_id, -avg(lv) AS loglikelihood, count(*) AS n_loops FROM lo GROUP BY item_id),
g AS (SELECT item_id, CASE WHEN len(list_filter(range(len(ids)), lambda q: {pred_diff})) = 0 THEN 1 ELSE 0 END AS is_greedy
      FROM (SELECT item_id, {TOK.sql_encode(cont)} AS ids FROM benchmark))
SELECT item_id, round(loglikelihood, 6) AS loglikelihood, n_loops::BIGINT AS n_loops, is_greedy::INTEGER AS is_greedy
FROM ll JOIN g USING (item_id)
"""


register("mc_loglik_bench", _sql_mc_ll())(mc_loglik_bench)


# ---------------------------------------------------------------- G9

THE_ID_SQL = TOK.sql_token_id("'the'")


def finished_blocks_docs(spark, sf_dir):
    d = encoded_docs(spark, sf_dir).select("doc_id", "input_ids")
    eos = spark.range(1).select(TOK.token_id(F.lit("the")).alias("e")).first()["e"]
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("input_ids") / 16.0).cast("int") - 1, F.lit(-1))),
                         lambda b: F.slice("input_ids", b * 16 + 1, 16))
    d = d.withColumn("fb", sc.finished_block(blocks, int(eos)))
    d = bt.assign_batches(d, 4, hash52(16, F.col("doc_id")), "doc_id")
    w = Window.partitionBy("batch_id")
    all_done = F.count(F.when(F.col("fb").isNull(), 1)).over(w) == 0
    return d.select("doc_id", "batch_id", F.coalesce("fb", F.lit(-1)).cast("bigint").alias("finished_block"),
                    F.coalesce(F.when(all_done, F.max("fb").over(w)), F.lit(-1)).cast("bigint").alias("batch_stop_block"))


register("finished_blocks_docs", f"""
WITH {SQL_DOCS},
f AS (SELECT doc_id, list_position(list_transform(range((len(ids) + 15) // 16),
          lambda b: list_contains(ids[b * 16 + 1: b * 16 + 16], {THE_ID_SQL})), true) - 1 AS fb FROM enc),
b AS (SELECT *, (row_number() OVER (ORDER BY {sql_hash52(16, 'doc_id')}, doc_id) - 1) // 4 AS batch_id FROM f)
SELECT doc_id, batch_id::BIGINT AS batch_id, coalesce(fb, -1)::BIGINT AS finished_block,
       coalesce(CASE WHEN count(*) FILTER (WHERE fb IS NULL) OVER (PARTITION BY batch_id) = 0
                     THEN max(fb) OVER (PARTITION BY batch_id) END, -1)::BIGINT AS batch_stop_block
FROM b
""")(finished_blocks_docs)


# ---------------------------------------------------------------- L7

def topk_positions_docs(spark, sf_dir):
    d = nz.apply_mask(noised_base(spark, sf_dir), MASK, "random", seed=2)
    n_masked = F.size(F.filter("masked", lambda b: b)).cast("bigint")
    # k = tokens revealed by the first of 8 linear steps
    r0 = reverse_transfer(F.lit(7 / 8), F.lit(1.0), "linear")
    k = F.least(F.rint(n_masked.cast("double") * r0).cast("bigint"), n_masked)
    conf = F.transform("input_ids", lambda x, i: sc.uniform(17, F.lit("conf"), F.col("doc_id"), i))
    pos = sc.topk_positions(conf, F.col("masked"), k)
    return d.select("doc_id", F.size(pos).cast("bigint").alias("k_used"),
                    F.md5(F.array_join(pos, ",")).alias("positions_md5"))


def _sql_topk() -> str:
    from tidepool.functions.schedules import sql_reverse_transfer
    r0 = sql_reverse_transfer("7.0::DOUBLE / 8", "8.0::DOUBLE / 8", "linear")
    conf = sql_uniform(17, "'conf'", "doc_id", "i - 1")
    return f"""
WITH {SQL_BASE},
m AS (SELECT doc_id, ids, list_transform(ids, lambda x, i: {_sql_u('m', 'i - 1')} < p AND labels[i] <> -100) AS masked FROM pm),
k AS (SELECT *, len(list_filter(masked, lambda b: b)) AS nm FROM m),
kk AS (SELECT *, least(round_even(nm::DOUBLE * {r0}, 0)::BIGINT, nm) AS k FROM k),
c AS (SELECT doc_id, k, list_filter(list_transform(ids, lambda x, i: CASE WHEN masked[i] THEN {{'nc': -{conf}, 'pos': i - 1}} END),
                                    lambda v: v IS NOT NULL) AS cand FROM kk)
SELECT doc_id, least(k, len(cand))::BIGINT AS k_used,
       md5(array_to_string(list_transform(list_sort(cand)[1:least(k, len(cand))], lambda s: s.pos), ',')) AS positions_md5
FROM c
"""


register("topk_positions_docs", _sql_topk())(topk_positions_docs)
