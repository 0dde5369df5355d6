"""Chat-data preparation queries over ``conversations`` (assemble, P1–P8,
F1, F2, F5, A4, A5, L1, V3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.text import checksum32
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import chat, normalise as nz, split as sp, tokens as tk
from tidepool.plans.registry import register
from tidepool.session import scratch_path
from tidepool.sources.readers import table

MAX_LEN = 512
NL = "chr(10)"

# ---------------------------------------------------------------- SQL bits

CONV_SQL = """
conv AS (
  SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages
  FROM conversations GROUP BY conv_id
)"""


def sql_chatml(msgs: str, gen: bool) -> str:
    body = (f"array_to_string(list_transform({msgs}, lambda m: '<|im_start|>' || m.role || {NL} "
            f"|| m.content || '<|im_end|>' || {NL}), '')")
    return f"({body} || '<|im_start|>assistant' || {NL})" if gen else body


def sql_split(key: str, seed: int = 42, frac: str = "0.05") -> str:
    h = f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13))::BIGINT)"
    return (f"CASE WHEN row_number() OVER (ORDER BY {h}, {key}) <= "
            f"ceil({frac} * count(*) OVER ()) THEN 'test' ELSE 'train' END")


def sql_checksum(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT)"


# ---------------------------------------------------------- flagship query

def chat_sft_frame(spark, sf_dir, max_len: int = MAX_LEN):
    """conversations -> messages -> 5 % split -> ChatML + SFT encode ->
    prompt-fits filter -> right clip.  The prepared-data frame."""
    conv = nz.assemble_messages(table(spark, sf_dir, "conversations"))
    conv = sp.split_exact(conv, "conv_id", 0.05, seed=42)
    enc = chat.encode_sft(conv, TOK, "chatml", mask_prompt_loss=True)
    return tk.post_process(enc, max_len, "right")


def chat_sft_summary(spark, sf_dir):
    df = chat_sft_frame(spark, sf_dir)
    n_loss = F.size(F.filter("labels", lambda x: x != F.lit(-100)))
    return (df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size("input_ids")).cast("bigint").alias("n_tokens"),
        F.sum(n_loss).cast("bigint").alias("n_loss_tokens"),
        F.sum("prompt_len").cast("bigint").alias("prompt_tokens"),
        F.sum(checksum32(F.array_join("input_ids", ","))).cast("bigint").alias("ids_checksum"),
    ))


CHAT_SFT_SUMMARY_SQL = f"""
WITH {CONV_SQL},
split AS (SELECT conv_id, messages, {sql_split('conv_id')} AS split FROM conv),
enc AS (
  SELECT split, {TOK.sql_encode(sql_chatml('messages', False))} AS ids,
         len({TOK.sql_tokens(sql_chatml('messages[1:len(messages)-1]', True))}) AS prompt_len
  FROM split
),
kept AS (SELECT split, ids[1:{MAX_LEN}] AS ids, prompt_len FROM enc WHERE prompt_len <= {MAX_LEN})
SELECT split, count(*)::BIGINT AS n_rows, sum(len(ids))::BIGINT AS n_tokens,
       sum(greatest(len(ids) - prompt_len, 0))::BIGINT AS n_loss_tokens,
       sum(prompt_len)::BIGINT AS prompt_tokens,
       sum({sql_checksum("array_to_string(ids, ',')")})::BIGINT AS ids_checksum
FROM kept GROUP BY split
"""

register("chat_sft_summary", CHAT_SFT_SUMMARY_SQL)(chat_sft_summary)


# ------------------------------------------------- P7 header / bracket

def chat_render_templates(spark, sf_dir):
    conv = nz.assemble_messages(table(spark, sf_dir, "conversations"))
    m = F.col("messages")
    return conv.select(
        "conv_id",
        F.md5(chat.render(m, "chatml", True)).alias("chatml_md5"),
        F.md5(chat.render(m, "header", True)).alias("header_md5"),
        F.md5(chat.render(m, "bracket", True)).alias("bracket_md5"),
        F.length(chat.render(m, "bracket", False)).cast("bigint").alias("bracket_chars"))


def _sql_strip(x: str) -> str:
    from tidepool.functions.text import PY_SPACE_CLASS
    return f"regexp_replace({x}, '\\A{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\\z', '', 'g')"


def _sql_templates() -> str:
    nl = "chr(10)"
    header = (f"array_to_string(list_transform(messages, lambda m, i: CASE WHEN i = 1 THEN '<|startoftext|>' ELSE '' END "
              f"|| '<|start_header_id|>' || m.role || '<|end_header_id|>' || {nl} || {nl} || {_sql_strip('m.content')} "
              f"|| '<|eot_id|>'), '') || CASE WHEN len(messages) = 0 OR messages[len(messages)].role <> 'assistant' "
              f"THEN '<|start_header_id|>assistant<|end_header_id|>' || {nl} || {nl} ELSE '' END")
    one = (f"CASE WHEN m.role = 'user' THEN '[Question]' || {nl} || {_sql_strip('m.content')} || {nl} || '[/Question]' || {nl} || {nl} "
           f"WHEN m.role = 'assistant' THEN '[Answer]' || {nl} || {_sql_strip('m.content')} || {nl} || '[/Answer]' || {nl} || {nl} "
           f"ELSE '' END")
    return f"""
WITH {CONV_SQL},
l AS (SELECT conv_id, messages, coalesce(messages[1].role = 'system', false) AS sys,
             CASE WHEN coalesce(messages[1].role = 'system', false) THEN messages[2:] ELSE messages END AS loop FROM conv),
b AS (SELECT conv_id, messages,
             CASE WHEN sys THEN '[SYS]' || {nl} || {_sql_strip('messages[1].content')} || {nl} || '[/SYS]' || {nl} || {nl} ELSE '' END
             || array_to_string(list_transform(loop, lambda m: {one}), '') AS body,
             (len(loop) = 0 OR loop[len(loop)].role <> 'assistant') AS need FROM l)
SELECT conv_id, md5({sql_chatml('messages', True)}) AS chatml_md5, md5({header}) AS header_md5,
       md5(body || CASE WHEN need THEN '[Answer]' || {nl} ELSE '' END) AS bracket_md5,
       length(body)::BIGINT AS bracket_chars
FROM b
"""


register("chat_render_templates", _sql_templates())(chat_render_templates)


# ------------------------------------------------------ P4 / F1 first exchange

def first_exchange_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    flat = nz.first_exchange_turns(turns)
    nested = nz.first_exchange(nz.assemble_messages(turns), keep=("conv_id",))
    agree = nested.where("valid").select("conv_id", F.col("prompt").alias("np"), F.col("response").alias("nr"))
    j = flat.join(agree, "conv_id", "left")
    return j.select("conv_id", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"),
                    ((F.col("np") == F.col("prompt")) & (F.col("nr") == F.col("response"))).cast("int").alias("nested_agrees"))


register("first_exchange_chat", f"""
WITH u AS (SELECT conv_id, min(turn) AS ut FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
a AS (SELECT c.conv_id, min(c.turn) AS at FROM conversations c JOIN u USING (conv_id)
      WHERE c.role = 'assistant' AND c.text IS NOT NULL AND c.turn > u.ut GROUP BY c.conv_id),
x AS (SELECT u.conv_id, {_sql_strip('cu.text')} AS prompt, {_sql_strip('ca.text')} AS response
      FROM u JOIN a USING (conv_id)
      JOIN conversations cu ON cu.conv_id = u.conv_id AND cu.turn = u.ut
      JOIN conversations ca ON ca.conv_id = a.conv_id AND ca.turn = a.at)
SELECT conv_id, md5(prompt) AS prompt_md5, md5(response) AS response_md5, 1 AS nested_agrees
FROM x WHERE prompt <> '' AND response <> ''
""")(first_exchange_chat)


# ----------------------------------------------------------- P3 reasoning

def reasoning_messages_chat(spark, sf_dir):
    """The messages, and how many conversations were left out and why, from
    one pass over the table."""
    rows = nz.reasoning_rows(table(spark, sf_dir, "conversations"))
    audit, path = nz.reasoning_audit(), scratch_path(spark, "reasoning")
    nz.norm_reasoning(audit.kept(rows), keep=("conv_id",)).write.parquet(path)
    m = F.col("messages")
    good = spark.read.parquet(path).select("conv_id", F.md5(F.concat(
        F.lit("user\x01"), m[0]["content"], F.lit("\x02assistant\x01"), m[1]["content"],
        F.lit("\x01"), m[1]["reasoning_content"])).alias("messages_md5"), F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("n"))
    none = F.lit(None)
    return good.unionByName(audit.report(rows).select(none.cast("long").alias("conv_id"), none.cast("string").alias("messages_md5"), "reason", "n"))


register("reasoning_messages_chat", """
WITH r AS (
  SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS question,
         list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS tr,
         arg_max(text, turn) FILTER (WHERE role = 'assistant') AS attempt
  FROM conversations GROUP BY conv_id),
w AS (SELECT *, CASE WHEN coalesce(len(tr), 0) = 0 THEN 'no_trace' WHEN question IS NULL THEN 'no_question' WHEN attempt IS NULL THEN 'no_attempt' ELSE 'kept' END AS reason FROM r)
SELECT conv_id, md5('user' || chr(1) || question || chr(2) || 'assistant' || chr(1) || attempt || chr(1) || tr[1]) AS messages_md5, NULL AS reason, 1::BIGINT AS n
FROM w WHERE reason = 'kept'
UNION ALL
SELECT NULL, NULL, k.reason, count(w.conv_id)::BIGINT FROM (VALUES ('no_trace'), ('no_question'), ('no_attempt'), ('kept')) k(reason)
LEFT JOIN w ON w.reason = k.reason GROUP BY k.reason
""")(reasoning_messages_chat)
