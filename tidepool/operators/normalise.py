"""Message normalisation (P1–P6, P13, F1–F3) and the row adapters that turn
the flat ``conversations`` table into the shapes the normalisers expect.

All operators are ``DataFrame -> DataFrame`` and compose with ``df.transform``.
Nothing here collects or shuffles except ``assemble_messages`` and
``first_exchange_turns`` (one hash aggregation on ``conv_id`` each, with
map-side partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.audit import Audit
from tidepool.functions.text import py_strip

MESSAGE = "struct<role:string,content:string>"


def message(role: Column | str, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.cast("string").alias("content"))


# ---------------------------------------------------------------- adapters

def assemble_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """Flat turns -> one row per conversation with ``messages`` ordered by turn.

    A conversation is one record of the data model (the reference's row), so
    its turns meet in one row; the aggregation is partial (map-side) first.
    """
    agg = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                               F.col(role).alias("role"),
                                               F.col(text).alias("content"))))
    return (turns.groupBy(key)
            .agg(agg.alias("_m"))
            .select(key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                              m["content"].alias("content")))
                    .alias("messages")))


def instruction_rows(turns: DataFrame) -> DataFrame:
    """Instruction-shaped rows from conversations: instruction = turn 0,
    output = turn 1, input = turn 2 (NULL when absent).  Partial aggregation
    only — safe for hot conversations."""
    return (turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("instruction"),
        F.max(F.when(F.col("turn") == 2, F.col("text"))).alias("input"),
        F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("output"),
    ))


def reasoning_rows(turns: DataFrame) -> DataFrame:
    """Reasoning-shaped rows: question = turn 0, thinking_trajectories = the
    assistant turns in order, attempt = the last assistant turn."""
    asst = F.col("role") == "assistant"
    return (turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("question"),
        F.array_sort(F.collect_list(F.when(asst, F.struct("turn", "text")))).alias("_tr"),
        F.max_by(F.when(asst, F.col("text")), F.when(asst, F.col("turn"))).alias("attempt"),
    ).select("conv_id", "question",
             F.transform("_tr", lambda s: s["text"]).alias("thinking_trajectories"),
             "attempt"))


# ------------------------------------------------------------- normalisers

def norm_instruction(df: DataFrame, instruction="instruction", input="input",
                     output="output", keep: tuple = ()) -> DataFrame:
    """Instruction (+ optional input) -> user message, output -> assistant.
    Missing/NULL fields count as ''; both parts stripped; blank line between
    them only when the stripped input is non-empty."""
    cols = set(df.columns)
    ins = py_strip(F.coalesce(F.col(instruction) if instruction in cols else F.lit(None).cast("string"), F.lit("")))
    inp = py_strip(F.coalesce(F.col(input) if input in cols else F.lit(None).cast("string"), F.lit("")))
    out = py_strip(F.coalesce(F.col(output) if output in cols else F.lit(None).cast("string"), F.lit("")))
    prompt = F.when(inp != "", F.concat(ins, F.lit("\n\n"), inp)).otherwise(ins)
    return df.select(*keep, F.array(message("user", prompt), message("assistant", out)).alias("messages"))


def norm_pair(df: DataFrame, instruction="instruction", output="output", keep: tuple = ()) -> DataFrame:
    """instruction/output -> two messages, no stripping."""
    return df.select(*keep, F.array(message("user", F.col(instruction)),
                                    message("assistant", F.col(output))).alias("messages"))


def no_trace() -> Column:
    """P3 predicate: a row has no reasoning trace to take."""
    return ~F.coalesce(F.size("thinking_trajectories") > 0, F.lit(False))


def norm_reasoning(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Question / first reasoning trace / attempt -> messages with
    ``reasoning_content``.  The reference raises on an empty trajectory list;
    such rows are left out (``reasoning_audit`` counts them on the way)."""
    msgs = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"),
                 F.lit(None).cast("string").alias("reasoning_content")),
        F.struct(F.lit("assistant").alias("role"), F.col("attempt").alias("content"),
                 F.get(F.col("thinking_trajectories"), 0).alias("reasoning_content")),
    )
    return df.where(~no_trace()).select(*keep, msgs.alias("messages"))


def reasoning_audit() -> Audit:
    """Counts of rows without a trace, a question or an attempt."""
    return Audit({"no_trace": no_trace(), "no_question": F.col("question").isNull(), "no_attempt": F.col("attempt").isNull()})


def first_exchange(df: DataFrame, messages="messages", keep: tuple = ()) -> DataFrame:
    """P4 on nested rows: first user message with string content, then the
    first assistant after it; strip both.  Returns ``prompt``/``response`` and
    ``valid`` (F1 = ``valid``).  No further search once the pair is found."""
    m = F.col(messages)
    idx = F.transform(m, lambda x, i: F.struct(i.alias("i"), x["role"].alias("role"),
                                              x["content"].alias("content")))
    users = F.filter(idx, lambda x: (x["role"] == "user") & x["content"].isNotNull())
    u = F.get(users, 0)
    after = F.filter(idx, lambda x: (x["role"] == "assistant") & x["content"].isNotNull()
                     & (x["i"] > u["i"]))
    a = F.get(after, 0)
    prompt = py_strip(u["content"])
    response = py_strip(a["content"])
    valid = (F.size(m) >= 2) & u.isNotNull() & a.isNotNull() & (prompt != "") & (response != "")
    return df.select(*keep, F.when(valid, prompt).alias("prompt"),
                     F.when(valid, response).alias("response"),
                     F.coalesce(valid, F.lit(False)).alias("valid"))


def first_exchange_turns(turns: DataFrame, key="conv_id") -> DataFrame:
    """P4/F1 on the flat turns table without assembling whole conversations:
    two partial aggregations on the key plus one key-equi join (AQE splits a
    hot conversation on the big side; the other side has one row per key)."""
    is_user = (F.col("role") == "user") & F.col("text").isNotNull()
    first_user = (turns.where(is_user).groupBy(key)
                  .agg(F.min("turn").alias("u_turn"),
                       F.min_by("text", "turn").alias("u_text")))
    is_asst = (F.col("role") == "assistant") & F.col("text").isNotNull()
    joined = turns.where(is_asst).join(first_user, key).where(F.col("turn") > F.col("u_turn"))
    # a user followed by an assistant implies at least two messages
    first_asst = (joined.groupBy(key)
                  .agg(F.min_by("text", "turn").alias("a_text"),
                       F.first("u_text").alias("u_text")))
    prompt, response = py_strip(F.col("u_text")), py_strip(F.col("a_text"))
    return (first_asst.where((prompt != "") & (response != ""))
            .select(key, prompt.alias("prompt"), response.alias("response")))


def has_first_exchange(df: DataFrame, messages="messages") -> DataFrame:
    """keep rows with a valid first exchange (single pass)."""
    cols = df.columns
    fx = first_exchange(df, messages, keep=tuple(cols))
    return fx.where("valid").select(*cols)


def rename_splits(df: DataFrame, mapping: dict, split_col="split") -> DataFrame:
    """P5: rename split names by ``mapping`` and drop every other split."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return (df.where(F.col(split_col).isin(list(mapping)))
            .withColumn(split_col, F.element_at(m, F.col(split_col))))


def keep_columns(df: DataFrame, names) -> DataFrame:
    """Keep only listed columns; missing names are ignored."""
    present = [c for c in names if c in df.columns]
    return df.select(*present)


def ensure_split(df: DataFrame, split_col="split", default="train") -> DataFrame:
    """A lone dataset becomes split ``train``; split columns pass through."""
    if split_col in df.columns:
        return df.withColumn(split_col, F.coalesce(F.col(split_col), F.lit(default)))
    return df.withColumn(split_col, F.lit(default))


def lang_in_answer(df: DataFrame, lang: str, messages="messages") -> DataFrame:
    """keep rows whose assistant text (message 1) contains ``lang``
    (case-sensitive substring)."""
    return df.where(F.col(messages)[1]["content"].contains(lang))


# configs whose language column is `lang` vs `program_lang`
# Config names accepted by the language-column filter.
LANG_COLUMN_CONFIGS = {
    "synthetic_code_snippet": "lang",
    "algorithmic_corpus": "lang",
    "synthetic_qa": "program_lang",
}


def lang_equals(df: DataFrame, lang: str, config: str | None = None,
                config_col: str = "config", column_by_config: dict | None = None,
                lang_col: str | None = None) -> DataFrame:
    """keep rows whose language column equals ``lang``.

    The language column depends on the config.  With ``lang_col`` given the
    filter is a plain equality that Catalyst pushes into the parquet scan.
    With ``config`` given the column is chosen at plan time; otherwise the
    choice is made per row from ``config_col``.  Unknown configs are errors.
    """
    if lang_col is not None:
        return df.where(F.col(lang_col) == lang)
    table = column_by_config or LANG_COLUMN_CONFIGS
    if config is not None:
        if config not in table:
            raise NotImplementedError(f"no language column known for config {config!r}")
        return df.where(F.col(table[config]) == lang)
    expr = None
    for cfg, col in table.items():
        if col not in df.columns:
            continue
        cond = (F.col(config_col) == cfg) & (F.col(col) == lang)
        expr = cond if expr is None else expr | cond
    known = F.col(config_col).isin(list(table))
    checked = F.when(known, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no language column for config "), F.col(config_col))))
    return df.where(checked & expr)
