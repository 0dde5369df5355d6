"""Sequence-operator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators.audit import Audit
from tidepool.functions.parallel import spread
from tidepool.functions.rand import hash52, sql_hash52, sql_uniform, sql_uniform_int
from tidepool.functions.text import md5_of_ids
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import batching as bt, chat, normalise as nz, tokens as tk
from tidepool.plans.registry import register
from tidepool.session import scratch_path
from tidepool.sources.readers import table

PAD, BOS, EOS, MASK = TOK.pad_token_id, TOK.bos_token_id, TOK.eos_token_id, TOK.mask_token_id


def encoded_docs(spark, sf_dir):
    """Whole documents as ids, with labels equal to them."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return tk.encode_text(d, "text", TOK).drop("text").withColumn("labels", F.col("input_ids"))


SQL_DOCS = f"enc AS (SELECT doc_id, lang, {TOK.sql_encode('text')} AS ids FROM documents)"


def sql_pad(arr: str, n: str, v) -> str:
    return f"list_concat({arr}, list_transform(range(greatest({n}, 0)), lambda _x: ({v})::BIGINT))"


def sql_md5_ids(arr: str) -> str:
    return f"md5(array_to_string({arr}, ','))"


# -------------------------------------------------------- A8 collate

def batch_collate_docs(spark, sf_dir):
    b = bt.batch_collate(encoded_docs(spark, sf_dir), 8, "doc_id", seed=11, pad_id=PAD)
    return b.select("doc_id", "batch_id", "row_in_batch",
                    F.size("input_ids").cast("bigint").alias("padded_len"),
                    md5_of_ids("input_ids").alias("ids_md5"), md5_of_ids("labels").alias("labels_md5"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attend"))


register("batch_collate_docs", f"""
WITH {SQL_DOCS},
r AS (SELECT doc_id, ids, row_number() OVER (ORDER BY {sql_hash52(11, 'doc_id')}, doc_id) - 1 AS rk FROM enc),
b AS (SELECT doc_id, ids, rk // 8 AS batch_id, rk % 8 AS row_in_batch, max(len(ids)) OVER (PARTITION BY rk // 8) AS mx FROM r)
SELECT doc_id, batch_id::BIGINT AS batch_id, row_in_batch::INTEGER AS row_in_batch, mx::BIGINT AS padded_len,
       {sql_md5_ids(sql_pad('ids', 'mx - len(ids)', PAD))} AS ids_md5,
       {sql_md5_ids(sql_pad('ids', 'mx - len(ids)', -100))} AS labels_md5,
       len(ids)::BIGINT AS n_attend
FROM b
""")(batch_collate_docs)


# --------------------------------------------------- A10 length buckets

def length_bucket_docs(spark, sf_dir):
    b = bt.length_bucket(encoded_docs(spark, sf_dir), 4, "doc_id", seed=5, bucket_width=16, pad_id=PAD)
    return b.select("doc_id", "length_bucket", "batch_id", "row_in_batch",
                    F.size("input_ids").cast("bigint").alias("padded_len"))


register("length_bucket_docs", f"""
WITH {SQL_DOCS},
r AS (SELECT doc_id, ids, len(ids) // 16 AS bk,
             row_number() OVER (ORDER BY len(ids) // 16, {sql_hash52(5, 'doc_id')} >> 12, doc_id) - 1 AS rk FROM enc)
SELECT doc_id, bk::BIGINT AS length_bucket, (rk // 4)::BIGINT AS batch_id, (rk % 4)::INTEGER AS row_in_batch,
       (max(len(ids)) OVER (PARTITION BY rk // 4))::BIGINT AS padded_len
FROM r
""")(length_bucket_docs)


# ------------------------------------- A9 align, A6 BOS rule, A7 truncation

def block_bos_truncate_docs(spark, sf_dir):
    d = encoded_docs(spark, sf_dir)
    # English documents get their first label ignored (a prompt-like prefix)
    d = d.withColumn("labels", F.when(F.col("lang") == "en", F.concat(
        F.array(F.lit(-100).cast("bigint")), F.slice("labels", F.lit(2), F.greatest(F.size("labels") - 1, F.lit(0))))).otherwise(F.col("labels")))
    d = bt.align_block(d, 32, EOS)
    d = bt.assign_batches(d, 4, hash52(3, F.col("doc_id")), "doc_id")
    d = tk.prepend_bos(d, BOS, batch_key="batch_id")
    d = bt.collate(d, PAD, -100)
    d = bt.random_truncate(d, seed=9, ratio=0.3)
    return d.select("doc_id", "batch_id", F.size("input_ids").cast("bigint").alias("seq_len"),
                    md5_of_ids("input_ids").alias("ids_md5"), md5_of_ids("labels").alias("labels_md5"),
                    md5_of_ids("attention_mask").alias("attention_md5"),
                    F.coalesce(F.col("truncated_at"), F.lit(-1)).cast("bigint").alias("truncated_at"))


def _sql_block_bos() -> str:
    u_hit = sql_uniform(9, "'trunc'", "batch_id")
    cut = sql_uniform_int(9, "1", "mx", "'len'", "batch_id")
    return f"""
WITH {SQL_DOCS},
lab AS (SELECT doc_id, ids, CASE WHEN lang = 'en' THEN list_concat([-100::BIGINT], ids[2:]) ELSE ids END AS labels FROM enc),
al AS (SELECT doc_id, {sql_pad('ids', '(32 - len(ids) % 32) % 32', EOS)} AS ids,
              {sql_pad('labels', '(32 - len(labels) % 32) % 32', EOS)} AS labels FROM lab),
r AS (SELECT *, (row_number() OVER (ORDER BY {sql_hash52(3, 'doc_id')}, doc_id) - 1) // 4 AS batch_id FROM al),
bos AS (SELECT *, bool_and(labels[1] = -100) OVER (PARTITION BY batch_id) AS skip FROM r),
pre AS (SELECT doc_id, batch_id,
               CASE WHEN skip THEN ids ELSE list_concat([{BOS}::BIGINT], ids) END AS ids,
               CASE WHEN skip THEN labels ELSE list_concat([-100::BIGINT], labels) END AS labels FROM bos),
col AS (SELECT doc_id, batch_id, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS mx, ids, labels FROM pre),
pad AS (SELECT doc_id, batch_id, mx, {sql_pad('ids', 'mx - n', PAD)} AS ids, {sql_pad('labels', 'mx - n', -100)} AS labels,
               list_concat(list_transform(range(n), lambda _x: 1::BIGINT), list_transform(range(mx - n), lambda _x: 0::BIGINT)) AS att
        FROM col),
tr AS (SELECT *, CASE WHEN {u_hit} < 0.3 THEN {cut} ELSE mx END AS cut, {u_hit} < 0.3 AS hit FROM pad)
SELECT doc_id, batch_id::BIGINT AS batch_id, mx::BIGINT AS seq_len, {sql_md5_ids('ids')} AS ids_md5,
       {sql_md5_ids("list_transform(labels, lambda x, i: CASE WHEN i - 1 < cut THEN x ELSE -100 END)")} AS labels_md5,
       {sql_md5_ids("list_transform(att, lambda x, i: CASE WHEN i - 1 < cut THEN x ELSE 0 END)")} AS attention_md5,
       (CASE WHEN hit THEN cut ELSE -1 END)::BIGINT AS truncated_at
FROM tr
"""


register("block_bos_truncate_docs", _sql_block_bos())(block_bos_truncate_docs)


# ------------------------------------------------- A4 / A5 clip variants

def sft_encoded(spark, sf_dir):
    conv = nz.assemble_messages(table(spark, sf_dir, "conversations"))
    return chat.encode_sft(conv, TOK, "chatml")


def clip_variants_chat(spark, sf_dir):
    enc = sft_encoded(spark, sf_dir).select("conv_id", "input_ids", "prompt_len")
    for c in ("r", "l", "kr", "kl"):
        enc = enc.withColumn(c, F.col("input_ids"))
    enc = tk.clip(enc, 64, "right", cols=("r",))
    enc = tk.clip(enc, 64, "left", cols=("l",))
    enc = tk.clip_keep_prompt(enc, 64, "right", cols=("kr",))
    enc = tk.clip_keep_prompt(enc, 64, "left", cols=("kl",))
    return enc.select("conv_id", md5_of_ids("r").alias("right_md5"), md5_of_ids("l").alias("left_md5"),
                      md5_of_ids("kr").alias("keep_right_md5"), md5_of_ids("kl").alias("keep_left_md5"),
                      F.size("kl").cast("bigint").alias("keep_left_len"))


def _sql_clip() -> str:
    from tidepool.plans.chat_queries import CONV_SQL, sql_chatml
    ids = TOK.sql_encode(sql_chatml("messages", False))
    plen = f"len({TOK.sql_tokens(sql_chatml('messages[1:len(messages)-1]', True))})"
    budget = "greatest(64 - least(pl, len(ids)), 0)"
    resp = "ids[pl + 1:]"
    keep_left = (f"list_concat(ids[1:pl], CASE WHEN {budget} = 0 THEN []::BIGINT[] "
                 f"ELSE ({resp})[greatest(len({resp}) - {budget} + 1, 1):] END)")
    return f"""
WITH {CONV_SQL},
enc AS (SELECT conv_id, {ids} AS ids, {plen} AS pl FROM conv)
SELECT conv_id, {sql_md5_ids('ids[1:64]')} AS right_md5,
       {sql_md5_ids('ids[greatest(len(ids) - 63, 1):]')} AS left_md5,
       {sql_md5_ids(f'list_concat(ids[1:pl], ({resp})[1:{budget}])')} AS keep_right_md5,
       {sql_md5_ids(keep_left)} AS keep_left_md5, len({keep_left})::BIGINT AS keep_left_len
FROM enc
"""


register("clip_variants_chat", _sql_clip())(clip_variants_chat)


# ---------------------------------------------------- V1 / V3 / F6 checks

#: The longest conversation, in ids, that a training row may hold.
SFT_LENGTH = 400


def sft_validation(spark, sf_dir):
    """V1–V3 on the conversations as they are: the rows that are fit, with
    their ids and labels, and how many are not and why, from one pass."""
    enc = chat.encode_sft(nz.assemble_messages(table(spark, sf_dir, "conversations")), TOK, "chatml")
    audit = Audit({**chat.sft_checks(enc), "labels_wrong": bt.label_violations(enc), "too_long": F.size("input_ids") > SFT_LENGTH})
    path = scratch_path(spark, "sft")
    audit.kept(enc).select("conv_id", "input_ids", "labels").write.parquet(path)
    eligible = F.size(F.filter(tk.loss_eligible("labels"), lambda b: b))
    rows = spark.read.parquet(path).select("conv_id", F.lit("row").alias("kind"), F.size("input_ids").cast("bigint").alias("n"), eligible.cast("bigint").alias("eligible"))
    none = F.lit(None).cast("bigint")
    return rows.unionByName(audit.report(enc).select(none.alias("conv_id"), F.col("reason").alias("kind"), "n", none.alias("eligible")))


def _sql_validation() -> str:
    from tidepool.plans.chat_queries import CONV_SQL, sql_chatml
    ids = TOK.sql_encode(sql_chatml("messages", False))
    plen = f"len({TOK.sql_tokens(sql_chatml('messages[1:len(messages)-1]', True))})"
    return f"""
WITH {CONV_SQL},
enc AS (SELECT conv_id, messages, {ids} AS ids, {plen} AS pl FROM conv),
w AS (SELECT *, CASE WHEN pl > len(ids) THEN 'prompt_longer_than_render' WHEN messages[len(messages)].role <> 'assistant' THEN 'last_role_not_assistant'
        WHEN len(ids) > {SFT_LENGTH} THEN 'too_long' ELSE 'kept' END AS kind FROM enc)
SELECT conv_id, 'row' AS kind, len(ids)::BIGINT AS n, greatest(len(ids) - pl, 0)::BIGINT AS eligible FROM w WHERE kind = 'kept'
UNION ALL
SELECT NULL, k.kind, count(w.conv_id)::BIGINT, NULL
FROM (VALUES ('message_without_content'), ('prompt_longer_than_render'), ('last_role_not_assistant'), ('labels_wrong'), ('too_long'), ('kept')) k(kind)
LEFT JOIN w ON w.kind = k.kind GROUP BY k.kind
"""


register("sft_validation", _sql_validation())(sft_validation)


# ------------------------------------------- A11 trim, A14 prompt batches

def trim_generation_docs(spark, sf_dir):
    d = encoded_docs(spark, sf_dir)
    pads = F.size("input_ids") % 4
    gen = F.concat(F.array_repeat(F.lit(PAD).cast("bigint"), pads),
                   F.transform("input_ids", lambda x, i: F.when(i == 20, F.lit(EOS).cast("bigint")).otherwise(x)))
    d = d.withColumn("gen_ids", gen).withColumn("prompt_len", F.lit(8))
    t = tk.trim_generation(d, PAD, EOS, TOK.eot_token_id)
    return t.select("doc_id", md5_of_ids("gen_trimmed").alias("trimmed_md5"),
                    F.size("gen_trimmed").cast("bigint").alias("trimmed_len"))


register("trim_generation_docs", f"""
WITH {SQL_DOCS},
g AS (SELECT doc_id, list_transform(ids, lambda x, i: CASE WHEN i = 21 THEN {EOS}::BIGINT ELSE x END) AS ids FROM enc),
c AS (SELECT doc_id, ids[9:] AS rest FROM g),
s AS (SELECT doc_id, rest, coalesce(list_position(list_transform(rest, lambda x: x IN ({EOS}, {TOK.eot_token_id})), true), len(rest) + 1) AS stop FROM c)
SELECT doc_id, {sql_md5_ids('rest[1:stop - 1]')} AS trimmed_md5, (stop - 1)::BIGINT AS trimmed_len FROM s
""")(trim_generation_docs)


def trim_text_docs(spark, sf_dir):
    """A11 after decoding: each document up to its first EOS string (a full
    stop stands for it here), and of that up to the first EOT string."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = tk.trim_text(d, "text", eos=". ", eot=", ")
    return t.select("doc_id", F.length("trimmed").cast("bigint").alias("n_chars"), F.md5("trimmed").alias("trimmed_md5"))


register("trim_text_docs", """
SELECT doc_id, length(split_part(split_part(text, '. ', 1), ', ', 1))::BIGINT AS n_chars, md5(split_part(split_part(text, '. ', 1), ', ', 1)) AS trimmed_md5
FROM documents
""")(trim_text_docs)


def token_lists_docs(spark, sf_dir):
    """Lists of ids given as text, as options hold them, back to ids."""
    d = encoded_docs(spark, sf_dir).select("doc_id", "input_ids")
    text = F.concat(F.lit("["), F.array_join(F.col("input_ids").cast("array<string>"), "; "), F.lit(";]"))
    d = d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.concat(F.lit(" "), F.array_join(F.col("input_ids").cast("array<string>"), ";"))))
    return d.select("doc_id", md5_of_ids(tk.token_list("text")).alias("ids_md5"), F.size(tk.token_list("text")).cast("bigint").alias("n"))


register("token_lists_docs", f"""
WITH {SQL_DOCS}
SELECT doc_id, {sql_md5_ids('ids')} AS ids_md5, len(ids)::BIGINT AS n FROM enc
""")(token_lists_docs)


def prompt_batches(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    b = b.withColumn("prompt_ids", TOK.encode(F.substring_index("text", ".", 1))).drop("text")
    b = bt.assign_batches(b, 4, F.col("item_id"), "item_id")
    r = bt.prompt_batch_right(b, 16, MASK, EOS)
    r = r.withColumnsRenamed({"canvas": "right", "attention_mask": "right_att"})
    lft = bt.prompt_batch_left(r, 8, PAD)
    return lft.select("item_id", "batch_id", md5_of_ids("right").alias("right_md5"), md5_of_ids("right_att").alias("right_att_md5"),
                      md5_of_ids("canvas").alias("left_md5"))


register("prompt_batches", f"""
WITH p AS (SELECT item_id, {TOK.sql_encode("split_part(text, '.', 1)")} AS ids FROM benchmark),
r AS (SELECT item_id, ids, (row_number() OVER (ORDER BY item_id) - 1) // 4 AS batch_id FROM p),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS mx FROM r)
SELECT item_id, batch_id::BIGINT AS batch_id,
  {sql_md5_ids(f"list_concat(list_concat(ids, list_transform(range(16), lambda _x: {MASK}::BIGINT)), list_transform(range(mx - len(ids)), lambda _x: {EOS}::BIGINT))")} AS right_md5,
  {sql_md5_ids("list_concat(list_transform(range(len(ids) + 16), lambda _x: 1::BIGINT), list_transform(range(mx - len(ids)), lambda _x: 0::BIGINT))")} AS right_att_md5,
  {sql_md5_ids(f"list_concat(list_transform(range(((mx + 7) // 8) * 8 - len(ids)), lambda _x: {PAD}::BIGINT), ids)")} AS left_md5
FROM m
""")(prompt_batches)


# ------------------------------------------- A12 stops, A13 pair split, V2

def eval_requests_bench(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    ctx = F.regexp_extract("text", r"^[^.]*\.[ ]*", 0)
    b = b.withColumn("context", ctx).withColumn("continuation", F.expr("substring(text, length(context) + 1)"))
    b = tk.split_pair(b, "context", "continuation", TOK)
    b = tk.cut_at_stops(b, "continuation", [".", ",", ""], out="cut")
    return (b.select("item_id", F.md5("context").alias("context_md5"), F.md5("continuation").alias("continuation_md5"),
                    F.size("context_ids").cast("bigint").alias("n_ctx"),
                    F.size("continuation_ids").cast("bigint").alias("n_cont"),
                     bt.too_long(32).cast("int").alias("rejected"), F.md5("cut").alias("cut_md5")))


register("eval_requests_bench", f"""
WITH b AS (SELECT item_id, text, regexp_extract(text, '^[^.]*\\.[ ]*', 0) AS raw_ctx FROM benchmark),
p AS (SELECT item_id, regexp_replace(raw_ctx, '[ ]+$', '') AS context,
             regexp_extract(raw_ctx, '([ ]*)$', 1) || substr(text, length(raw_ctx) + 1) AS continuation FROM b),
e AS (SELECT *, len({TOK.sql_tokens('context')}) AS n_ctx,
             len({TOK.sql_tokens('context || continuation')}) AS n_all FROM p)
SELECT item_id, md5(context) AS context_md5, md5(continuation) AS continuation_md5, n_ctx::BIGINT AS n_ctx,
       greatest(n_all - n_ctx, 0)::BIGINT AS n_cont,
       CASE WHEN n_ctx + greatest(n_all - n_ctx, 0) > 32 THEN 1 ELSE 0 END AS rejected,
       md5(split_part(split_part(continuation, '.', 1), ',', 1)) AS cut_md5
FROM e
""")(eval_requests_bench)
