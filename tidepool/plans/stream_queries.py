"""Streaming queries (S4, L4, L5, U3, T1–T4).  Each stream reads the table
where it lies, runs over all available input (``availableNow``) into a sink
under the shared checkpoint folder, and the registered query returns the sink
read back, so that it can be compared with the batch computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.rand import hash52, sql_hash52
from tidepool.functions.text import md5_of_ids
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import tokens as tk
from tidepool.plans.registry import register
from tidepool.session import scratch_path
from tidepool.sources.readers import table
from tidepool.streaming import streams as st
from tidepool.streaming.state import CHUNKS

EOS = TOK.eos_token_id


def _documents(spark, root, options):
    t = table(spark, root, "documents")
    lang = options.pop("lang", None)

    def select(df):
        df = df if lang is None else df.where(F.col("lang") == lang)
        return df.select("doc_id", "lang", "text")

    return st.StreamTable(f"{root.rstrip('/')}/documents.parquet", t.schema, select)


def _benchmark(spark, root, options):
    return st.StreamTable(f"{root.rstrip('/')}/benchmark.parquet", table(spark, root, "benchmark").schema,
                          lambda df: df.select(F.col("item_id").alias("doc_id"), F.lit("bench").alias("lang"), "text"))


STREAMS = {"documents": _documents, "benchmark": _benchmark}


def _docs(spark, sf_dir):
    return st.stream_corpus(spark, "local/documents", STREAMS, sf_dir)[0]


# ------------------------------------------------------- S4 + T1 + T3

def stream_filter_clip_docs(spark, sf_dir):
    s = tk.encode_text(_docs(spark, sf_dir), "text", TOK).drop("text")
    s = tk.clip(tk.filter_length(s, 512), 128, "right")
    out, ck = scratch_path(spark, "t1-out"), scratch_path(spark, "t1-ck")
    st.run_to_parquet(s.select("doc_id", "input_ids"), out, ck)
    r = spark.read.parquet(out)
    return r.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"), md5_of_ids("input_ids").alias("ids_md5"))


register("stream_filter_clip_docs", f"""
WITH e AS (SELECT doc_id, {TOK.sql_encode('text')} AS ids FROM documents)
SELECT doc_id, len(ids[1:128])::BIGINT AS n_tokens, md5(array_to_string(ids[1:128], ',')) AS ids_md5
FROM e WHERE len(ids) <= 512
""")(stream_filter_clip_docs)


# ------------------------------------------------ T2 exact (carried lanes)

#: A lane of the query holds this many documents' ids in a row.
LANE_DOCS = 500


def stream_pack_stateful_docs(spark, sf_dir):
    s = tk.encode_text(_docs(spark, sf_dir), "text", TOK)
    s = s.withColumn("lane", F.floor(F.col("doc_id") / LANE_DOCS).cast("long"))
    out, ck = scratch_path(spark, "t2-out"), scratch_path(spark, "t2-ck")
    st.pack_lanes(s, out, ck, 128, eos_id=EOS)
    return spark.read.schema(CHUNKS).parquet(out).select("lane", "chunk_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                                            md5_of_ids("input_ids").alias("ids_md5"))


def _sql_lane_pack(group: str, L: int) -> str:
    return f"""
WITH docs AS (SELECT doc_id, {group} AS g, {TOK.sql_encode('text')} AS ids FROM documents),
eos AS (SELECT doc_id, g, CASE WHEN len(ids) > 0 AND ids[len(ids)] = {EOS} THEN ids
                              ELSE list_append(ids, {EOS}::BIGINT) END AS ids FROM docs),
tok AS (SELECT doc_id, g, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS p FROM eos),
pos AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) - 1 AS gp FROM tok),
ch AS (SELECT g, gp // {L} AS chunk_id, string_agg(id::VARCHAR, ',' ORDER BY gp) AS s, count(*) AS n
       FROM pos GROUP BY g, gp // {L})"""


register("stream_pack_stateful_docs", _sql_lane_pack(f"doc_id // {LANE_DOCS}", 128) + """
SELECT g::BIGINT AS lane, chunk_id::BIGINT AS chunk_id, n::BIGINT AS n_tokens, md5(s) AS ids_md5
FROM ch WHERE n = 128
""")(stream_pack_stateful_docs)


# ----------------------------------------- T2 reference shape (per batch)

def stream_pack_per_batch_docs(spark, sf_dir):
    s = tk.encode_text(_docs(spark, sf_dir), "text", TOK).select("doc_id", "input_ids")
    out, ck = scratch_path(spark, "t2b-out"), scratch_path(spark, "t2b-ck")
    st.pack_per_batch(s, out, ck, 128, eos_id=EOS)
    r = spark.read.parquet(out)
    return r.select("pack_group", "chunk_id", F.size("input_ids").cast("bigint").alias("n_tokens"), md5_of_ids("input_ids").alias("ids_md5"))


register("stream_pack_per_batch_docs", _sql_lane_pack("(row_number() OVER (ORDER BY doc_id) - 1) // 1000", 128) + """
SELECT g::BIGINT AS pack_group, chunk_id::BIGINT AS chunk_id, n::BIGINT AS n_tokens, md5(s) AS ids_md5
FROM ch WHERE n = 128
""")(stream_pack_per_batch_docs)


# ------------------------------------------------ L4 on a stream, U3

def stream_splits_docs(spark, sf_dir):
    """Two sources of one spec in one stream; the first has limits."""
    s, sources = st.stream_corpus(spark, "local/documents[train:300,test:50] + local/benchmark", STREAMS, sf_dir)
    out, ck = scratch_path(spark, "l4-out"), scratch_path(spark, "l4-ck")
    st.split_stream(s.select("source_rank", "doc_id", "lang"), sources, out, ck, order_in_batch="doc_id")
    return spark.read.parquet(out).select("source_rank", "doc_id", "lang", "split", F.col("position").cast("bigint"))


register("stream_splits_docs", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
SELECT 0 AS source_rank, doc_id, lang, CASE WHEN position < 50 THEN 'test' ELSE 'train' END AS split, position::BIGINT AS position
FROM r WHERE position < 350
UNION ALL
SELECT 1, item_id, 'bench', 'train', (row_number() OVER (ORDER BY item_id) - 1)::BIGINT FROM benchmark
""")(stream_splits_docs)


# ------------------------------------------------------------- L5 take

def stream_take_docs(spark, sf_dir):
    """Which rows a stream gives first is not fixed, so the query shows how
    many were taken, how many are different and how many belong to the table."""
    s = st.stream_take(_docs(spark, sf_dir), 100).select("doc_id", "lang")
    out, ck = scratch_path(spark, "l5-out"), scratch_path(spark, "l5-ck")
    st.run_to_parquet(s, out, ck)
    taken = spark.read.parquet(out)
    whole = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("here"))
    return taken.join(whole, ["doc_id", "lang"], "left").agg(
        F.count(F.lit(1)).alias("n_taken"), F.count_distinct("doc_id").alias("n_distinct"), F.count("here").alias("n_of_table"))


register("stream_take_docs", """
SELECT least(count(*), 100)::BIGINT AS n_taken, least(count(*), 100)::BIGINT AS n_distinct, least(count(*), 100)::BIGINT AS n_of_table
FROM documents
""")(stream_take_docs)


# ----------------------------------------------------- T4 running metrics

def stream_running_metrics(spark, sf_dir):
    ev = st.StreamTable(f"{sf_dir.rstrip('/')}/events.parquet", table(spark, sf_dir, "events").schema,
                        lambda df: df.select("event_id", "user_id", "event_type", "value"))
    s = st.read_stream(spark, ev)
    s = s.withColumn("split", F.when(F.col("event_type") == "error", "eval").otherwise("train")).withColumn("w", F.lit(1.0))
    out = scratch_path(spark, "t4-out")
    st.write_updates(st.running_metrics(s, "user_id", "split", "value", "w"), out, scratch_path(spark, "t4-ck"))
    return st.latest(spark, out, ["user_id", "split"]).select(
        "user_id", "split", F.round("mean", 6).alias("mean"), F.col("weight").cast("bigint").alias("weight"))


register("stream_running_metrics", """
SELECT user_id, CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS split,
       round(avg(value), 6) AS mean, count(*)::BIGINT AS weight
FROM events GROUP BY 1, 2
""")(stream_running_metrics)


# ------------------------------- G4 on a stream: reset at evaluation marks

SLICES = 4


def stream_interval_metrics(spark, sf_dir):
    """The run log in four slices of time.  The stream reads two, one a
    micro-batch, and stops; two more are added and it goes on from its
    checkpoint.  Intervals run across slices and the restart."""
    from tidepool.plans.metric_queries import MICROS, run_metrics
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(MICROS).alias("at"))
    src, out, ck = scratch_path(spark, "g4-log"), scratch_path(spark, "g4-out"), scratch_path(spark, "g4-ck")
    edges = log.agg(F.percentile_approx("at", [k / SLICES for k in range(1, SLICES)]).alias("e")).first()["e"] or []
    slice_ = sum(((F.col("at") > e).cast("int") for e in edges), F.lit(0))
    stream = st.StreamTable(src, log.schema)
    columns = dict(run="user_id", at=F.col("at"), tiebreak=F.col("event_id"), is_mark=F.col("event_type") == "signup",
                   split=F.when(F.col("event_type") == "error", F.lit("eval")).otherwise(F.lit("train")))
    for half in (range(SLICES // 2), range(SLICES // 2, SLICES)):
        for k in half:
            log.where(slice_ == k).coalesce(1).write.parquet(f"{src}/slice={k}")
        st.interval_metrics(st.read_stream(spark, stream, files_per_trigger=1), run_metrics(), out, ck, **columns)
    last = st.latest(spark, out, ["run", "eval_interval", "split", "metric"])
    return run_metrics().logged(last).select(F.col("run").cast("long").alias("user_id"), "eval_interval", "key", "rows", F.round("value", 9).alias("value"))


register("stream_interval_metrics", """
WITH r AS (
  SELECT *, count(*) FILTER (WHERE event_type = 'signup')
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS eval_interval,
         CASE WHEN event_type = 'error' THEN 'eval_' ELSE '' END AS pre
  FROM events),
g AS (SELECT user_id, eval_interval::BIGINT AS eval_interval, pre, count(value)::BIGINT AS rows, avg(value) AS m,
        sum(value * (1 + event_id % 3)) / sum(CASE WHEN value IS NOT NULL THEN 1 + event_id % 3 END) AS w
      FROM r WHERE event_type <> 'signup' GROUP BY ALL)
SELECT user_id, eval_interval, pre || 'loss' AS key, rows, round(m, 9) AS value FROM g WHERE rows > 0
UNION ALL SELECT user_id, eval_interval, pre || 'ppl', rows, round(exp(m / 1000), 9) FROM g WHERE rows > 0
UNION ALL SELECT user_id, eval_interval, pre || 'weighted', rows, round(w, 9) FROM g WHERE rows > 0
""")(stream_interval_metrics)


# -------------------------------------- V2, F4 on a stream: reject counts

def stream_audit_docs(spark, sf_dir):
    """Documents of at most 512 ids pass; what does not is counted by reason
    in the same scan, micro-batch by micro-batch."""
    s = tk.encode_text(_docs(spark, sf_dir), "text", TOK).select("doc_id", "lang", "input_ids")
    checks = {"no_ids": F.size("input_ids") == 0, "too_long": F.size("input_ids") > 512, "not_en": F.col("lang") != "en"}
    out = scratch_path(spark, "v2-out")
    reasons = st.write_audited(s, checks, out, scratch_path(spark, "v2-ck"))
    rows = spark.read.parquet(out).select(F.lit("row").alias("kind"), "doc_id", F.size("input_ids").cast("bigint").alias("n"))
    return rows.unionByName(reasons.select(F.col("reason").alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), "n"))


register("stream_audit_docs", f"""
WITH e AS (SELECT doc_id, lang, len({TOK.sql_tokens('text')}) AS n FROM documents),
w AS (SELECT *, CASE WHEN n = 0 THEN 'no_ids' WHEN n > 512 THEN 'too_long' WHEN lang <> 'en' THEN 'not_en' ELSE 'kept' END AS kind FROM e)
SELECT 'row' AS kind, doc_id, n::BIGINT AS n FROM w WHERE kind = 'kept'
UNION ALL
SELECT k.kind, NULL, count(w.doc_id)::BIGINT FROM (VALUES ('no_ids'), ('too_long'), ('not_en'), ('kept')) k(kind) LEFT JOIN w ON w.kind = k.kind GROUP BY k.kind
""")(stream_audit_docs)


# --------------------------------------- U3, S4: streams one after another

def stream_concat_docs(spark, sf_dir):
    """English documents, then the benchmark, then the French ones."""
    streams, _ = st.stream_sources(spark, "local/documents[lang:en] + local/benchmark + local/documents[lang:fr]", STREAMS, sf_dir)
    out = scratch_path(spark, "u3-out")
    st.concat_streams([s.select("doc_id", "lang") for s in streams], out, scratch_path(spark, "u3-ck"), order_in_batch="doc_id")
    return spark.read.parquet(out).select(F.col("source_rank").cast("bigint").alias("source_rank"), "doc_id", "lang", F.col("position").cast("bigint"))


register("stream_concat_docs", """
WITH u AS (SELECT 0 AS source_rank, doc_id, lang FROM documents WHERE lang = 'en'
           UNION ALL SELECT 1, item_id, 'bench' FROM benchmark
           UNION ALL SELECT 2, doc_id, lang FROM documents WHERE lang = 'fr')
SELECT source_rank::BIGINT AS source_rank, doc_id, lang, (row_number() OVER (ORDER BY source_rank, doc_id) - 1)::BIGINT AS position FROM u
""")(stream_concat_docs)
