"""Source/sink queries (S1, S5, S7, S8, S9, P6, P13, G6).  Written tables go
to fresh folders under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.rand import sql_uniform, uniform
from tidepool.functions.text import md5_of_ids
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import metric_state as ms, normalise as nz, scoring as sc, split as sp, tokens as tk
from tidepool.plans.chat_queries import sql_split
from tidepool.plans.metric_queries import run_log
from tidepool.plans.registry import register
from tidepool.session import scratch_path
from tidepool.sources import readers as rd


# ------------------------------------------- S7 write, S5/S1 read back

def prepared_roundtrip_docs(spark, sf_dir):
    d = rd.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d = tk.encode_text(d, "text", TOK).withColumnRenamed("source", "config")
    d = sp.split_exact(nz.ensure_split(d.drop("split") if "split" in d.columns else d).drop("split"),
                       "doc_id", 0.05, seed=42)
    d = nz.keep_columns(d, ["doc_id", "input_ids", "split", "config", "attention_mask"])
    path = rd.write_prepared(d, scratch_path(spark, "prepared"),
                             {"max_length": 1024, "insert_eos": False, "drop_tail": True})
    back = rd.read_table(spark, path, config="src3", split="train")
    back = back.unionByName(rd.read_prepared(spark, path).where(F.col("split") == "test"))
    return back.select("doc_id", "split", F.size("input_ids").cast("bigint").alias("n_tokens"),
                       md5_of_ids("input_ids").alias("ids_md5"))


register("prepared_roundtrip_docs", f"""
WITH s AS (SELECT doc_id, source, {TOK.sql_encode('text')} AS ids, {sql_split('doc_id')} AS split FROM documents)
SELECT doc_id, split, len(ids)::BIGINT AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5
FROM s WHERE (source = 'src3' AND split = 'train') OR split = 'test'
""")(prepared_roundtrip_docs)


# --------------------------------- S6 all configs or one, F3 by config

def configs_roundtrip_docs(spark, sf_dir):
    """Documents written in three configs, whose language column differs;
    read back as all configs in one scan with the language filter, and as
    one named config."""
    names = F.array(*(F.lit(c) for c in sorted(nz.LANG_COLUMN_CONFIGS)))
    d = rd.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    d = d.withColumn("config", F.get(names, (F.col("doc_id") % 3).cast("int")))
    qa = F.col("config") == "synthetic_qa"
    d = d.withColumn("program_lang", F.when(qa, F.col("lang"))).withColumn("lang", F.when(~qa, F.col("lang")))
    path = rd.write_prepared(d, scratch_path(spark, "configs"))
    every = rd.read_all_configs(spark, path, normaliser=lambda df: nz.lang_equals(df, "en"))
    one = rd.read_all_configs(spark, path, config="synthetic_qa")
    both = every.withColumn("part", F.lit("en of all")).unionByName(one.withColumn("part", F.lit("synthetic_qa")))
    return both.groupBy("part", "config").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("key_sum"),
                                              F.sum(F.length("text")).alias("n_chars"))


register("configs_roundtrip_docs", """
WITH d AS (SELECT doc_id, lang, text, (['algorithmic_corpus', 'synthetic_code_snippet', 'synthetic_qa'])[doc_id % 3 + 1] AS config FROM documents),
u AS (SELECT 'en of all' AS part, * FROM d WHERE lang = 'en' UNION ALL SELECT 'synthetic_qa', * FROM d WHERE config = 'synthetic_qa')
SELECT part, config, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS key_sum, sum(length(text))::BIGINT AS n_chars FROM u GROUP BY part, config
""")(configs_roundtrip_docs)


# --------------------------------------- S8 results files + G6 summary

def _task_metrics(spark, sf_dir):
    """Metrics of two runs with five tasks: names and "N/A" beside numbers, a
    real score of 0.0, a task with only text and one without any metric."""
    b = rd.table(spark, sf_dir, "benchmark").select("item_id")
    b = (b.withColumn("run", F.concat(F.lit("run"), (F.col("item_id") % 2).cast("string")))
          .withColumn("task", F.concat(F.lit("task_"), (F.floor(F.col("item_id") / 2) % 5).cast("string")))
          .withColumn("hit", (uniform(31, F.lit("acc"), F.col("item_id")) < 0.5).cast("double")))
    per = b.groupBy("run", "task").agg(F.avg("hit").alias("acc"))
    at = lambda *tasks: F.col("task").isin(*(f"task_{t}" for t in tasks))
    one = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("metric"), value.cast("string").alias("value")))
    metrics = F.array(one(at(0, 1, 2, 3), "alias", F.col("task")), one(at(0, 1), "acc,none", F.col("acc")), one(at(3), "acc,none", F.lit(0.0)),
                      one(at(2), "acc,none", F.lit("N/A")), one(at(3), "em,none", F.col("acc") / 2), one(at(1), "acc_stderr,none", F.lit("N/A")))
    return per.select("run", "task", F.explode_outer(F.filter(metrics, lambda m: m.isNotNull())).alias("m")).select("run", "task", "m.metric", "m.value")


def results_summary(spark, sf_dir):
    base = scratch_path(spark, "results")
    rd.write_results(_task_metrics(spark, sf_dir), base)
    res = rd.read_results(spark, f"{base}/*/results.json")
    run = F.regexp_extract("path", r"run=([^/]+)", 1).alias("run")
    strict, truthy = (sc.score_summary(res, compat=c) for c in (False, True))
    return (strict.select("path", "task", F.round("score_value", 6).alias("score"), (F.col("score") == "N/A").cast("int").alias("is_na"))
            .join(truthy.select("path", "task", F.round("score_value", 6).alias("score_truthy")), ["path", "task"])
            .select(run, "task", "score", "score_truthy", "is_na"))


register("results_summary", f"""
WITH b AS (SELECT item_id, 'run' || (item_id % 2) AS run, 'task_' || ((item_id // 2) % 5) AS task,
                  ({sql_uniform(31, "'acc'", 'item_id')} < 0.5)::INTEGER::DOUBLE AS hit FROM benchmark),
p AS (SELECT run, task, avg(hit) AS acc FROM b GROUP BY run, task),
m AS (SELECT run, task, CASE WHEN task IN ('task_0', 'task_1') THEN acc WHEN task = 'task_3' THEN 0.0 END AS a,
             CASE WHEN task = 'task_3' THEN acc / 2 END AS e FROM p)
SELECT run, task, round(coalesce(a, e), 6) AS score, round(coalesce(nullif(a, 0), nullif(e, 0)), 6) AS score_truthy,
       (coalesce(a, e) IS NULL)::INTEGER AS is_na FROM m
""")(results_summary)


# ------------------------------------------------------------ S9 run log

def run_log_append(spark, sf_dir):
    """The metrics of four jobs; two of them ran twice."""
    e = run_log(spark, sf_dir)
    mark = F.col("event_type") == "signup"
    split = F.when(F.col("event_type") == "error", F.lit("eval")).otherwise(F.lit("train"))
    m = sc.metrics_by_interval(e, "user_id", ["ts", "event_id"], mark, split, ms.Metrics({"loss": ms.Metric(F.col("value"))}), F.col("bucket"))
    m = m.withColumnRenamed("user_id", "run").withColumn("job", F.col("run") % 4)
    path = scratch_path(spark, "runlog")
    rd.append_run_log(m.where("job < 2"), path)
    rd.append_run_log(m.where("job > 0"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("run").cast("bigint").alias("run")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 6).alias("value_sum"))


register("run_log_append", """
WITH r AS (
  SELECT *, count(*) FILTER (WHERE event_type = 'signup')
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k,
         CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS split
  FROM events
),
g AS (SELECT user_id, k, split, avg(value) AS v FROM r WHERE event_type <> 'signup' GROUP BY user_id, k, split)
SELECT user_id AS run, count(*)::BIGINT AS n_rows, round(sum(v), 6) AS value_sum FROM g GROUP BY user_id
""")(run_log_append)


# -------------------------------------------- S9 prompts and generations

def generation_log_bench(spark, sf_dir):
    """What each item's first sentence led to (the rest of the item stands for
    it), logged at three steps; the second step is logged twice."""
    b = rd.table(spark, sf_dir, "benchmark")
    prompt = F.substring_index("text", ".", 1)
    rows = b.select(F.lit("base").alias("run"), prompt.alias("prompt"), F.expr("substring(text, length(substring_index(text, '.', 1)) + 1)").alias("generation"),
                    F.explode(F.array(*map(F.lit, (100, 200, 300)))).alias("step"))
    path = scratch_path(spark, "generations")
    for steps in ((100, 200), (200, 300)):
        rd.log_generations(rows.where(F.col("step").isin(*steps)), path)
    back = spark.read.parquet(path).select("run", F.col("step").cast("bigint").alias("step"), "prompt", "generation")
    return back.groupBy("run", "step", F.md5("prompt").alias("prompt_md5")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.md5("generation")).alias("generation_md5"))


register("generation_log_bench", """
SELECT 'base' AS run, s::BIGINT AS step, md5(split_part(text, '.', 1)) AS prompt_md5, count(*)::BIGINT AS n,
       max(md5(substr(text, length(split_part(text, '.', 1)) + 1))) AS generation_md5
FROM benchmark, (VALUES (100), (200), (300)) t(s) GROUP BY ALL
""")(generation_log_bench)
