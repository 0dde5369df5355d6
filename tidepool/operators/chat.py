"""Chat rendering (P7) and SFT encoding (P8) as column jobs.

Templates are re-expressed as array expressions: ``transform`` renders each
message, ``array_join`` concatenates — whole-stage friendly, no Python.
The three templates and their whitespace follow the Jinja templates the
reference installs (compiled the way chat-template libraries do, with
``trim_blocks`` and ``lstrip_blocks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.audit import Audit
from tidepool.functions.text import py_strip
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER

IGNORE = -100

# Template markers.
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
HDR_START, HDR_END, EOT = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"


def _last_role(msgs: Column) -> Column:
    return F.element_at(msgs, -1)["role"]


def render_chatml(msgs: Column, add_generation_prompt: bool | Column = False) -> Column:
    body = F.array_join(F.transform(msgs, lambda m: F.concat(
        F.lit(IM_START), m["role"], F.lit("\n"), m["content"], F.lit(IM_END + "\n"))), "")
    gen = add_generation_prompt if isinstance(add_generation_prompt, Column) else F.lit(add_generation_prompt)
    return F.concat(body, F.when(gen, F.lit(IM_START + "assistant\n")).otherwise(F.lit("")))


def _gen_suffix(msgs: Column, gen, text: str) -> Column:
    g = gen if isinstance(gen, Column) else F.lit(gen)
    need = g & ((F.size(msgs) == 0) | (F.coalesce(_last_role(msgs), F.lit("")) != "assistant"))
    return F.when(need, F.lit(text)).otherwise(F.lit(""))


def render_header(msgs: Column, add_generation_prompt=False, bos_token: str = "<|startoftext|>") -> Column:
    body = F.array_join(F.transform(msgs, lambda m, i: F.concat(
        F.when(i == 0, F.lit(bos_token)).otherwise(F.lit("")),
        F.lit(HDR_START), m["role"], F.lit(HDR_END + "\n\n"), py_strip(m["content"]), F.lit(EOT))), "")
    return F.concat(body, _gen_suffix(msgs, add_generation_prompt, HDR_START + "assistant" + HDR_END + "\n\n"))


def render_bracket(msgs: Column, add_generation_prompt=False) -> Column:
    has_sys = F.coalesce(F.get(msgs, 0)["role"] == "system", F.lit(False))
    sys_block = F.when(has_sys, F.concat(F.lit("[SYS]\n"), py_strip(F.get(msgs, 0)["content"]),
                                         F.lit("\n[/SYS]\n\n"))).otherwise(F.lit(""))
    loop = F.when(has_sys, F.slice(msgs, 2, F.greatest(F.size(msgs) - 1, F.lit(0)))).otherwise(msgs)

    def one(m):
        c = py_strip(m["content"])
        return (F.when(m["role"] == "user", F.concat(F.lit("[Question]\n"), c, F.lit("\n[/Question]\n\n")))
                .when(m["role"] == "assistant", F.concat(F.lit("[Answer]\n"), c, F.lit("\n[/Answer]\n\n")))
                .otherwise(F.lit("")))

    body = F.array_join(F.transform(loop, one), "")
    return F.concat(sys_block, body, _gen_suffix(loop, add_generation_prompt, "[Answer]\n"))


TEMPLATES = {"chatml": render_chatml, "header": render_header, "bracket": render_bracket}


def render(msgs: Column, template: str = "chatml", add_generation_prompt=False) -> Column:
    try:
        fn = TEMPLATES[template.lower()]
    except KeyError:
        raise ValueError(f"unknown template {template!r}; available: {sorted(TEMPLATES)}") from None
    return F.when(~incomplete(msgs), fn(msgs, add_generation_prompt))


def incomplete(msgs: Column) -> Column:
    """Some message has no role or no content; such a conversation renders to
    null as a whole (it is not rendered without the message) and is a reject."""
    return F.coalesce(F.exists(msgs, lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull()), F.lit(True))


def render_chat(df: DataFrame, template: str = "chatml", add_generation_prompt: bool = False,
                messages: str = "messages", out: str = "text") -> DataFrame:
    """Add the rendered conversation as a string column."""
    return df.withColumn(out, render(F.col(messages), template, add_generation_prompt))


def all_but_last(msgs: Column) -> Column:
    return F.slice(msgs, 1, F.greatest(F.size(msgs) - 1, F.lit(0)))


def mask_prefix(ids: Column, n: Column) -> Column:
    """labels = ids with the first ``n`` set to -100.  Like Python slice
    assignment, an ``n`` longer than ``ids`` extends the list."""
    rest = F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(IGNORE).cast("bigint"), n), rest)


def encode_sft(df: DataFrame, tokenizer=DEFAULT_TOKENIZER, template: str = "chatml",
               mask_prompt_loss: bool = True, messages: str = "messages") -> DataFrame:
    """``input_ids`` of the full render; ``prompt_len`` = token count of
    ``messages[:-1]`` rendered with the generation prompt; ``labels`` = ids
    with the prompt masked to -100 (no ``prompt_len`` when not masking)."""
    msgs = F.col(messages)
    ids = tokenizer.encode(render(msgs, template, False))
    out = df.withColumn("input_ids", ids)
    if not mask_prompt_loss:
        return out.withColumn("labels", F.col("input_ids"))
    count = getattr(tokenizer, "count", None)
    prompt_text = render(all_but_last(msgs), template, True)
    plen = (count(prompt_text) if count else F.size(tokenizer.encode(prompt_text))).cast("int")
    return (out.withColumn("prompt_len", plen)
            .withColumn("labels", mask_prefix(F.col("input_ids"), F.col("prompt_len"))))


def sft_checks(df: DataFrame, messages: str = "messages") -> dict[str, Column]:
    """V3: why an encoded row is unfit, as predicates by reason."""
    last = F.coalesce(F.get(F.col(messages), F.size(messages) - 1)["role"], F.lit(""))
    return {"message_without_content": incomplete(F.col(messages)),
            "prompt_longer_than_render": F.col("prompt_len") > F.size("input_ids"),
            "last_role_not_assistant": last != "assistant"}


def sft_reject_reason(df: DataFrame, messages: str = "messages") -> Column:
    """V3 as a column: the first reason that holds, null if the row is fit."""
    return Audit(sft_checks(df, messages)).reason()


def sft_rejects(df: DataFrame, messages: str = "messages") -> DataFrame:
    """V3: rows with a message that lacks role or content, whose last role is
    not assistant, or whose prompt is longer than the full render (where the
    reference's label slice would extend), with the reason."""
    return df.withColumn("reason", sft_reject_reason(df, messages)).where("reason is not null")
