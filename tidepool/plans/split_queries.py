"""Split / limit / ordering / set-operation queries (S2, S3, L1–L4, L6,
U1, U2, U4, P1, P2, P5, P13, F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.permute import sql_permuted, sql_round_keys
from tidepool.functions.rand import hash52, sql_hash52
from tidepool.functions.text import PY_SPACE_CLASS
from tidepool.operators import normalise as nz, split as sp
from tidepool.plans.chat_queries import sql_split
from tidepool.plans.registry import register
from tidepool.sources.mixture import load_corpus, load_mixture
from tidepool.sources.readers import table

SQL_STRIP = f"'\\A{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\\z'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {SQL_STRIP}, '', 'g')"


def messages_md5(col="messages"):
    return F.md5(F.array_join(F.transform(col, lambda m: F.concat(m["role"], F.lit("\x01"), m["content"])), "\x02"))


# -------------------------------------------------------------- L1 split

def split_exact_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sp.split_exact(d, "doc_id", 0.05, seed=42)


register("split_exact_docs", f"SELECT doc_id, {sql_split('doc_id')} AS split FROM documents")(split_exact_docs)


# ----------------------------------------------------- L4 disjoint split

def split_disjoint_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sp.derive_splits_disjoint(d, n_train=600, n_test=100, order_by="doc_id").select("doc_id", "lang", "split")


register("split_disjoint_docs", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, lang, CASE WHEN rn <= 100 THEN 'test' ELSE 'train' END AS split FROM r WHERE rn <= 700
""")(split_disjoint_docs)


# ------------------------------------------------ L6 shuffle, U4 epochs

def shuffle_epochs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    rep = sp.with_epochs(d, 2)
    return sp.shuffle(rep, "doc_id", seed=7, epoch=F.col("epoch"), sort=False)


register("shuffle_epochs", f"""
SELECT doc_id, e AS epoch, {sql_hash52(7, 'e', 'doc_id')} AS shuffle_key
FROM documents, range(2) t(e)
""")(shuffle_epochs)


def shuffle_positions_docs(spark, sf_dir):
    """The place of every document in each epoch's order; one rank
    serves all epochs."""
    return sp.epoch_positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3, seed=7).select("doc_id", "epoch", "position")


register("shuffle_positions_docs", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
k AS (SELECT doc_id, x, n, e::INTEGER AS epoch, {sql_round_keys(7, 'e')} AS keys FROM r, range(3) t(e))
SELECT doc_id, epoch, {sql_permuted('x', 'n', 'keys')} AS position FROM k
""")(shuffle_positions_docs)


# -------------------------------------------------- S2 chat mixture

def _instructions(spark, root, opts):
    rows = nz.instruction_rows(table(spark, root, "conversations"))
    msgs = nz.norm_instruction(rows, keep=("conv_id",)).withColumnRenamed("conv_id", "key")
    return sp.Unsplit(msgs, "key", 0.05, 42)


def _pairs(spark, root, opts):
    rows = nz.instruction_rows(table(spark, root, "conversations"))
    msgs = nz.norm_pair(rows, keep=("conv_id",)).withColumnRenamed("conv_id", "key")
    lang = opts.pop("lang", None)
    if lang is None:
        return sp.Unsplit(msgs, "key", 0.05, 42)
    return sp.Unsplit(msgs, "key", 0.05, 42, then=lambda df: nz.lang_in_answer(df, lang))  # after the split


def _chats(spark, root, opts):
    return nz.assemble_messages(table(spark, root, "conversations")).withColumnRenamed("conv_id", "key")


CHAT_REGISTRY = {"instructions": _instructions, "pairs": _pairs, "conversations": _chats}
MIX_SPEC = "local/instructions[train:400,test:10] + local/pairs[lang:the] | local/conversations[train:50,test:20]"


def chat_mixture(spark, sf_dir):
    mix = load_mixture(spark, MIX_SPEC, CHAT_REGISTRY, sf_dir)
    return mix.select("source", "split", F.col("key").alias("conv_id"),
                      messages_md5("messages").alias("messages_md5"))


def _sql_msg_md5(u: str, a: str) -> str:
    return f"md5('user' || chr(1) || {u} || chr(2) || 'assistant' || chr(1) || {a})"


register("chat_mixture", f"""
WITH inst AS (
  SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS instruction,
         max(CASE WHEN turn = 2 THEN text END) AS input, max(CASE WHEN turn = 1 THEN text END) AS output
  FROM conversations GROUP BY conv_id
),
p1 AS (
  SELECT conv_id, {sql_strip("coalesce(instruction, '')")} AS ins, {sql_strip("coalesce(input, '')")} AS inp,
         {sql_strip("coalesce(output, '')")} AS outp
  FROM inst
),
p1s AS (
  SELECT conv_id, CASE WHEN inp <> '' THEN ins || chr(10) || chr(10) || inp ELSE ins END AS u, outp AS a,
         {sql_split('conv_id')} AS split FROM p1
),
p1l AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY conv_id) AS rn FROM p1s
),
a AS (
  SELECT 'local/instructions' AS source, split, conv_id, {_sql_msg_md5('u', 'a')} AS messages_md5 FROM p1l
  WHERE (split = 'train' AND rn <= 400) OR (split = 'test' AND rn <= 10)
),
p2 AS (SELECT conv_id, instruction AS u, output AS a, {sql_split('conv_id')} AS split FROM inst),
b AS (
  SELECT 'local/pairs' AS source, split, conv_id, {_sql_msg_md5('u', 'a')} AS messages_md5
  FROM p2 WHERE contains(a, 'the')
),
conv AS (
  SELECT conv_id, md5(string_agg(role || chr(1) || text, chr(2) ORDER BY turn)) AS messages_md5,
         row_number() OVER (ORDER BY conv_id) AS rn
  FROM conversations GROUP BY conv_id
),
c AS (
  SELECT 'local/conversations' AS source, 'train' AS split, conv_id, messages_md5 FROM conv WHERE rn <= 50
  UNION ALL
  SELECT 'local/conversations' AS source, 'test' AS split, conv_id, messages_md5 FROM conv WHERE rn <= 20
)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c
""")(chat_mixture)


# ---------------------------------------------------- S3 corpus mixture

def _documents(spark, root, opts):
    d = table(spark, root, "documents").select("doc_id", "source", "lang", "text")
    cfg = opts.pop("name", None)
    if cfg is not None:
        d = d.where(F.col("source") == cfg)         # config = partition-like column, pushed down
    lang = opts.pop("lang", None)
    if lang is not None:
        d = nz.lang_equals(d, lang, lang_col="lang")
    return d.withColumnRenamed("doc_id", "key")


CORPUS_SPEC = "corpus/documents[name:src1,train:30,test:5] + corpus/documents[name:src2,lang:en]"


def corpus_mixture(spark, sf_dir):
    mix = load_corpus(spark, CORPUS_SPEC, {"documents": _documents}, sf_dir)
    return mix.select("split", F.col("key").alias("doc_id"), "lang", F.md5("text").alias("text_md5"))


register("corpus_mixture", """
WITH s1 AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE source = 'src1')
SELECT 'train' AS split, doc_id, lang, md5(text) AS text_md5 FROM s1 WHERE rn <= 30
UNION ALL SELECT 'test', doc_id, lang, md5(text) FROM s1 WHERE rn <= 5
UNION ALL SELECT 'train', doc_id, lang, md5(text) FROM documents WHERE source = 'src2' AND lang = 'en'
""")(corpus_mixture)


# ---------------------------------------------- P5 rename splits, U1

def renamed_splits_concat(spark, sf_dir):
    """P5 + U1: a source with train_sft/test_sft/other splits is renamed to
    train/test (others dropped), then concatenated with a second part."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    tagged = d.withColumn("split", F.when(F.col("source").isin("src0", "src1"), "test_sft")
                          .when(F.col("source").isin("src2", "src3"), "gen")
                          .otherwise("train_sft"))
    renamed = nz.rename_splits(tagged, {"train_sft": "train", "test_sft": "test"})
    other = nz.ensure_split(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")))
    both = sp.concat_splits(renamed.select("doc_id", "split"), other, source_col="part",
                            sources=("documents", "benchmark"))
    return both.groupBy("part", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("key_sum"))


register("renamed_splits_concat", """
WITH r AS (
  SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'test'
                      WHEN source IN ('src2', 'src3') THEN NULL ELSE 'train' END AS split
  FROM documents
),
u AS (SELECT 'documents' AS part, split, doc_id FROM r WHERE split IS NOT NULL
      UNION ALL SELECT 'benchmark', 'train', item_id FROM benchmark)
SELECT part, split, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS key_sum FROM u GROUP BY part, split
""")(renamed_splits_concat)
