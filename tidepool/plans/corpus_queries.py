"""Corpus queries over ``documents``.

``lang`` plays the language column and ``source`` the config."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.parallel import spread
from tidepool.functions.text import checksum32, md5_of_ids
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool import steps
from tidepool.operators import normalise as nz, pack as pk, tokens as tk
from tidepool.plans.registry import register
from tidepool.session import scratch_path
from tidepool.sources.readers import table

EOS = TOK.eos_token_id


def docs_encoded(spark, sf_dir, cols=("doc_id",)):
    d = spread(table(spark, sf_dir, "documents").select(*cols, "text"), "doc_id")
    return tk.encode_text(d, "text", TOK).drop("text")


# ------------------------------------------------------------------ packing

def grouped_docs(docs):
    """Documents with the group of 1,000 rows that they are packed in, one
    group a partition; tokens are made after that."""
    return tk.encode_text(pk.assign_pack_group(docs, "doc_id", 1000).repartition("pack_group"), "text", TOK)


def corpus_pack(spark, sf_dir):
    enc = grouped_docs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chunks = pk.pack(enc, 128, key="doc_id", drop_tail=True, eos_id=EOS)
    return chunks.select("pack_group", "chunk_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                         md5_of_ids("input_ids").alias("ids_md5"),
                         (F.col("input_ids") == F.col("labels")).cast("int").alias("labels_equal"))


def _sql_pack(where: str, L: int, keep_tail: bool) -> str:
    tail = "" if keep_tail else f"WHERE n = {L}"
    return f"""
WITH docs AS (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS g, {TOK.sql_encode('text')} AS ids FROM documents {where}
),
eos AS (
  SELECT doc_id, g, CASE WHEN len(ids) > 0 AND ids[len(ids)] = {EOS} THEN ids
                         ELSE list_append(ids, {EOS}::BIGINT) END AS ids FROM docs
),
tok AS (SELECT doc_id, g, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS p FROM eos),
pos AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) - 1 AS gp FROM tok),
ch AS (SELECT g, gp // {L} AS chunk_id, string_agg(id::VARCHAR, ',' ORDER BY gp) AS s, count(*) AS n
       FROM pos GROUP BY g, gp // {L})
SELECT g::BIGINT AS pack_group, chunk_id::BIGINT AS chunk_id, n::BIGINT AS n_tokens, md5(s) AS ids_md5,
       1 AS labels_equal
FROM ch {tail}
"""


register("corpus_pack", _sql_pack("", 128, False))(corpus_pack)


def corpus_pack_en_keep_tail(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    enc = grouped_docs(nz.lang_equals(d, "en", lang_col="lang").drop("lang"))
    chunks = pk.pack(enc, 256, key="doc_id", drop_tail=False, eos_id=EOS)
    return chunks.select("pack_group", "chunk_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                         md5_of_ids("input_ids").alias("ids_md5"),
                         (F.col("input_ids") == F.col("labels")).cast("int").alias("labels_equal"))


register("corpus_pack_en_keep_tail", _sql_pack("WHERE lang = 'en'", 256, True))(corpus_pack_en_keep_tail)


# ------------------------------------------------------- per-config stats

def corpus_config_stats(spark, sf_dir):
    """S6 + P9 + F4: all configs in one scan; per config (= source) and
    language: documents, tokens, documents fitting 512 tokens, checksum."""
    enc = docs_encoded(spark, sf_dir, ("doc_id", "source", "lang"))
    # one pass: the F4 length predicate is counted inside the same aggregation
    fits = F.col("input_ids").isNotNull() & (F.size("input_ids") <= 512)
    return enc.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size("input_ids")).cast("bigint").alias("n_tokens"),
        F.count(F.when(fits, 1)).cast("bigint").alias("n_fit"),
        F.sum(checksum32(F.array_join("input_ids", ","))).cast("bigint").alias("ids_checksum"))


register("corpus_config_stats", f"""
WITH enc AS (SELECT source, lang, {TOK.sql_encode('text')} AS ids FROM documents)
SELECT source, lang, count(*)::BIGINT AS n_docs, sum(len(ids))::BIGINT AS n_tokens,
       count(*) FILTER (WHERE len(ids) <= 512)::BIGINT AS n_fit,
       sum(('0x' || substr(md5(array_to_string(ids, ',')), 1, 8))::BIGINT)::BIGINT AS ids_checksum
FROM enc GROUP BY source, lang
""")(corpus_config_stats)


# ------------------------------------------------------------------ decode

def corpus_decode(spark, sf_dir):
    """P12 + P11: decode stand-in ids back to text through the vocabulary of
    the corpus, skipping special ids (EOS appended, then stripped).  The corpus
    is tokenised once: tokens and ids are written, and both the vocabulary and
    the decoding read them."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    path, special = scratch_path(spark, "encoded"), [TOK.pad_token_id, EOS, TOK.bos_token_id]
    tokens = d.select("doc_id", TOK.tokens(F.col("text")).alias("tokens"))
    tokens.withColumn("input_ids", F.transform("tokens", TOK.token_id)).write.parquet(path)
    enc = spark.read.parquet(path)
    pair = F.explode(F.arrays_zip("input_ids", "tokens")).alias("p")
    vocab = enc.select(pair).select(F.col("p.input_ids").alias("id"), F.col("p.tokens").alias("token"))
    enc = tk.append_eos(enc.drop("tokens"), EOS)
    stripped = tk.strip_special(enc, special, out="clean_ids").withColumn("n_clean", F.size("clean_ids").cast("bigint"))
    dec = tk.decode(stripped.select("doc_id", "n_clean", "input_ids"), vocab, skip_ids=special)
    return dec.select("doc_id", F.md5("decoded").alias("decoded_md5"), "n_clean")


register("corpus_decode", f"""
WITH tok AS (SELECT doc_id, {TOK.sql_tokens('text')} AS toks FROM documents),
ids AS (SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS p FROM tok),
idt AS (SELECT doc_id, p, token, {TOK.sql_token_id('token')} AS id FROM ids),
vocab AS (SELECT id, min(token) AS token FROM idt GROUP BY id),
dec AS (
  SELECT i.doc_id, string_agg(v.token, ' ' ORDER BY i.p) AS decoded, count(*) AS n
  FROM idt i JOIN vocab v USING (id) WHERE i.id NOT IN (0, 1, 2) GROUP BY i.doc_id
)
SELECT d.doc_id, md5(coalesce(dec.decoded, '')) AS decoded_md5, coalesce(dec.n, 0)::BIGINT AS n_clean
FROM documents d LEFT JOIN dec USING (doc_id)
""")(corpus_decode)


# ------------------------------------- steps by name, with a wrapper around

CHAIN = """[
  {"step": "encode_text"},
  {"step": "append_eos"},
  {"step": "truncate", "max_length": 512, "truncation": "filter"},
  {"step": "keep_columns", "names": ["doc_id", "lang", "input_ids"]}
]"""


def steps_chain_docs(spark, sf_dir):
    """A preparation job from text: every step is called by its name."""
    run = steps.standard(TOK).chain(CHAIN, [steps.DropColumns("text")])
    d = run(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id"))
    return d.select("doc_id", "lang", F.size("input_ids").cast("bigint").alias("n"), md5_of_ids("input_ids").alias("ids_md5"))


register("steps_chain_docs", f"""
WITH e AS (SELECT doc_id, lang, {TOK.sql_encode('text')} AS ids FROM documents),
x AS (SELECT doc_id, lang, CASE WHEN len(ids) > 0 AND ids[len(ids)] = {EOS} THEN ids ELSE list_append(ids, {EOS}::BIGINT) END AS ids FROM e),
c AS (SELECT * FROM x WHERE len(ids) <= 512)
SELECT doc_id, lang, len(ids)::BIGINT AS n, md5(array_to_string(ids, ',')) AS ids_md5 FROM c
""")(steps_chain_docs)
