"""Token-sequence operators on array columns (P9, P11, P12, A1, A4, A5, A6,
A11, A12, A13, F4, F5, F6).

Every operator is an array expression evaluated row by row inside the JVM —
no token is exploded unless a join needs it (``decode``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.session import scratch_path
from tidepool.functions.text import TRAILING_SPACE_PATTERN, py_rstrip
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER

IGNORE = -100
SEQ_COLS = ("input_ids", "labels", "attention_mask")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ encode

def encode_text(df: DataFrame, text: str = "text", tokenizer=DEFAULT_TOKENIZER,
                out: str = "input_ids") -> DataFrame:
    """Token ids of a text column (special tokens are not added)."""
    return df.withColumn(out, tokenizer.encode(F.col(text)))


def loss_eligible(labels: str | Column = "labels") -> Column:
    """per-position eligibility ``labels != -100`` as array<boolean>."""
    return F.transform(_c(labels), lambda x: x != F.lit(IGNORE))


def append_eos(df: DataFrame, eos_id: int, ids: str = "input_ids") -> DataFrame:
    """A1: append EOS unless the sequence already ends with it; [] -> [eos]."""
    if not eos_id:
        raise ValueError("eos id must be a non-zero id")
    c = F.col(ids)
    ends = (F.size(c) > 0) & (F.element_at(c, F.greatest(F.size(c), F.lit(1))) == F.lit(eos_id))
    return df.withColumn(ids, F.when(ends, c).otherwise(
        F.concat(c, F.array(F.lit(eos_id).cast("bigint")))))


def strip_special(df: DataFrame, ids_to_drop, ids: str = "input_ids", out: str | None = None) -> DataFrame:
    """Drop special/pad/EOS ids (keeps duplicates of other ids — unlike
    ``array_except``)."""
    drop = [F.lit(int(i)) for i in ids_to_drop]
    return df.withColumn(out or ids, F.filter(F.col(ids), lambda x: ~x.isin(*drop)))


# ---------------------------------------------------------------- filters

def filter_length(df: DataFrame, max_length: int, ids: str = "input_ids") -> DataFrame:
    """keep rows with ``len(input_ids) <= max_length`` (rows without a
    list are dropped)."""
    return df.where(F.col(ids).isNotNull() & (F.size(ids) <= max_length))


def filter_prompt_fits(df: DataFrame, max_length: int) -> DataFrame:
    """keep ``prompt_len <= max_length`` — only when the column exists
    (decided from the schema at plan time); NULL prompt_len is dropped."""
    if "prompt_len" not in df.columns:
        return df
    return df.where(F.col("prompt_len").isNotNull() & (F.col("prompt_len") <= max_length))


# ------------------------------------------------------------------- clip

def clip_array(c: Column, n: int, side: str = "right") -> Column:
    if side == "right":
        return F.slice(c, 1, n)
    if side == "left":
        # last n elements; whole array when shorter
        return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)
    raise NotImplementedError(side)


def clip(df: DataFrame, max_length: int, side: str = "right", cols=SEQ_COLS) -> DataFrame:
    """A4: keep the first (right) or last (left) ``max_length`` positions of
    every sequence column present."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, clip_array(F.col(c), max_length, side))
    return df


#: What is done with rows that are too long, by mode: steps in their order.
TRUNCATION = {
    "filter": (filter_length,),
    "right": (filter_prompt_fits, clip),
}


def post_process(df: DataFrame, max_length: int, truncation: str = "filter") -> DataFrame:
    """Drops rows that are too long (``filter``), or keeps those whose prompt
    fits and cuts them at the end (``right``)."""
    if truncation not in TRUNCATION:
        raise ValueError(f"truncation is one of {sorted(TRUNCATION)}, not {truncation!r}")
    for step in TRUNCATION[truncation]:
        df = step(df, max_length)
    return df


def clip_keep_prompt(df: DataFrame, max_length: int, side: str = "right",
                     cols=SEQ_COLS, compat: bool = False) -> DataFrame:
    """A5: keep the prompt whole and clip only the response to
    ``max(0, max_length - prompt_len)``.  With ``side='left'`` and a zero
    budget the reference keeps the whole response (``resp[-0:]``); by default
    we keep none — ``compat=True`` reproduces the reference."""
    pl = F.col("prompt_len")
    for name in cols:
        if name not in df.columns:
            continue
        c = F.col(name)
        prompt = F.slice(c, 1, pl)
        resp = F.slice(c, pl + 1, F.greatest(F.size(c) - pl, F.lit(0)))
        budget = F.greatest(F.lit(max_length) - F.size(prompt), F.lit(0))
        if side == "right":
            kept = F.slice(resp, 1, budget)
        elif side == "left":
            tail = F.slice(resp, F.greatest(F.size(resp) - budget + 1, F.lit(1)), budget)
            kept = F.when(budget == 0, resp if compat else F.array().cast("array<bigint>")).otherwise(tail)
        else:
            raise NotImplementedError(side)
        clipped = F.concat(prompt, kept)
        df = df.withColumn(name, F.when(pl.isNotNull() & (pl >= 0), clipped)
                           .otherwise(clip_array(c, max_length, side)))
    return df


# ----------------------------------------------------------------- BOS

def prepend_bos(df: DataFrame, bos_id: int, batch_key: str | None = "batch_id",
                always: bool = False) -> DataFrame:
    """Prepend BOS (label -100, attention 1) — skipped for a whole batch
    when every row of the batch already starts with label -100.

    The per-batch rule is a window ``bool_and`` over ``batch_key``; batches
    are bounded (the batch size), so the window task stays small.
    """
    from pyspark.sql import Window
    if always or batch_key is None or "labels" not in df.columns:
        skip = F.lit(False)
    else:
        first_ignored = F.coalesce(F.get(F.col("labels"), 0) == F.lit(IGNORE), F.lit(False))
        skip = F.bool_and(first_ignored).over(Window.partitionBy(batch_key))
    df = df.withColumn("_skip_bos", skip)
    add = ~F.col("_skip_bos")
    df = df.withColumn("input_ids", F.when(add, F.concat(F.array(F.lit(bos_id).cast("bigint")), "input_ids"))
                       .otherwise(F.col("input_ids")))
    if "labels" in df.columns:
        df = df.withColumn("labels", F.when(add, F.concat(F.array(F.lit(IGNORE).cast("bigint")), "labels"))
                           .otherwise(F.col("labels")))
    if "attention_mask" in df.columns:
        df = df.withColumn("attention_mask", F.when(add, F.concat(F.array(F.lit(1).cast("bigint")), "attention_mask"))
                           .otherwise(F.col("attention_mask")))
    return df.drop("_skip_bos")


# --------------------------------------------------------- generation cut

def trim_generation(df: DataFrame, pad_id: int, eos_id: int, eot_id: int | None = None,
                    ids: str = "gen_ids", prompt_len: str = "prompt_len",
                    out: str = "gen_trimmed") -> DataFrame:
    """Drop left pads, take what follows the prompt (its length counted
    after the pads were removed), stop before the first EOS or EOT."""
    c = F.col(ids)
    # index of the first non-pad (1-based); all-pad -> size+1
    first_real = F.coalesce(
        F.get(F.filter(F.transform(c, lambda x, i: F.when(x != F.lit(pad_id), i + 1)),
                       lambda v: v.isNotNull()), 0),
        F.size(c) + 1)
    unpadded = F.slice(c, first_real, F.greatest(F.size(c) - first_real + 1, F.lit(0)))
    gen = F.slice(unpadded, F.col(prompt_len) + 1, F.greatest(F.size(unpadded) - F.col(prompt_len), F.lit(0)))
    stops = [F.lit(eos_id)] + ([F.lit(eot_id)] if eot_id is not None else [])
    stop_at = F.coalesce(F.get(F.filter(F.transform(gen, lambda x, i: F.when(x.isin(*stops), i + 1)),
                                        lambda v: v.isNotNull()), 0), F.size(gen) + 1)
    return df.withColumn(out, F.slice(gen, 1, stop_at - 1))


def trim_text(df: DataFrame, text: str, eos: str | None = None, eot: str | None = None, out: str = "trimmed") -> DataFrame:
    """A11 after decoding: the text before the first EOS string, and of that
    what stands before the first EOT string, where a tokenizer has these as
    text only.  Null and empty strings cut nothing."""
    return cut_at_stops(df, text, [s for s in (eos, eot) if s], out=out)


def token_list(text: Column | str) -> Column:
    """A list of ids given as text, ``[1;2;3]`` with or without the brackets;
    null and empty texts give an empty list, what is no number raises."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    bare = F.when(c.startswith("[") & c.endswith("]"), F.regexp_replace(c, r"^\[|\]$", "")).otherwise(c)
    return F.transform(F.filter(F.transform(F.split(F.coalesce(bare, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("bigint"))


def cut_at_stops(df: DataFrame, text: str = "text", stops: str | list = "until",
                 out: str = "cut") -> DataFrame:
    """Cut text at each stop string in list order (``split(s)[0]``
    repeatedly).  Empty stop strings are ignored (Python would raise)."""
    arr = F.col(stops) if isinstance(stops, str) else F.array(*[F.lit(s) for s in stops])
    cut = F.aggregate(arr, F.col(text),
                      lambda acc, s: F.when((s.isNull()) | (s == ""), acc)
                      .otherwise(F.call_function("substring_index", acc, s, F.lit(1))))
    return df.withColumn(out, cut)


def split_pair(df: DataFrame, context: str = "context", continuation: str = "continuation",
               tokenizer=DEFAULT_TOKENIZER) -> DataFrame:
    """Move trailing whitespace of the context to the continuation;
    continuation ids = ids of (context + continuation) minus the first
    len(ids(context)) — as the reference encodes."""
    ws = F.regexp_extract(F.col(context), TRAILING_SPACE_PATTERN, 1)
    ctx = py_rstrip(F.col(context))
    cont = F.concat(ws, F.col(continuation))
    df = df.withColumns({context: ctx, continuation: cont})   # both from the input row
    whole = tokenizer.encode(F.concat(F.col(context), F.col(continuation)))
    ctx_ids = tokenizer.encode(F.col(context))
    df = df.withColumn("whole_ids", whole).withColumn("context_ids", ctx_ids)
    return (df.withColumn("continuation_ids",
                          F.slice("whole_ids", F.size("context_ids") + 1,
                                  F.greatest(F.size("whole_ids") - F.size("context_ids"), F.lit(0))))
            .drop("whole_ids"))


# ----------------------------------------------------------------- decode

def vocab_table(df: DataFrame, text: str = "text", tokenizer=DEFAULT_TOKENIZER) -> DataFrame:
    """Vocabulary (id -> token) of the stand-in tokenizer observed in a text
    column; hash collisions resolved by ``min(token)``.  At most vocab-size
    rows (151,920), so it is safe to broadcast."""
    toks = df.select(F.explode(tokenizer.tokens(F.col(text))).alias("token"))
    return (toks.groupBy(tokenizer.token_id(F.col("token")).alias("id"))
            .agg(F.min("token").alias("token")))


#: Bytes of the vocabulary that are sent to the tasks at a time.
VOCAB_BYTES = 64 << 20


def decode(df: DataFrame, vocab: DataFrame, ids: str = "input_ids", skip_ids=(), out: str = "decoded") -> DataFrame:
    """Ids -> text (tokens joined by a space), skipping special ids;
    unknown ids decode to ``<unk:ID>``, no ids to an empty text.  Of the tokens
    that a vocabulary has for one id, the smallest counts.

    The vocabulary is sent as two Arrow arrays, in shards of ``VOCAB_BYTES``
    (all real ones are one), and every batch is decoded by array look-ups: no
    row per token and no shuffle.  What a shard does not hold waits for the
    next; rows are written between shards, so a task never holds two."""
    vocab = vocab.groupBy("id").agg(F.min("token").alias("token"))
    need = vocab.agg(F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0))).first()[0]
    shards, spark = max(1, -(-need // VOCAB_BYTES)), df.sparkSession
    rows, kept = df.withColumn("_tokens", F.lit(None).cast("array<string>")), [int(i) for i in skip_ids]
    for shard in range(shards):
        known = vocab if shards == 1 else vocab.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard)
        rows = _decoded(rows, known, ids, kept, last=shard == shards - 1)
        if shard < shards - 1:
            path = scratch_path(spark, "decoded")
            rows.write.parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
    text = F.array_join(F.filter("_tokens", lambda t: t.isNotNull()), " ")
    return rows.withColumn(out, F.coalesce(text, F.lit(""))).drop("_tokens")


#: Ids that are decoded at a time, whatever the number of rows in a batch.
IDS_AT_A_TIME = 1 << 18


def _pieces(batch, column: int, size: int | None = None):
    """``batch`` in runs of rows of at most ``size`` ids together, or one row."""
    import numpy as np
    import pyarrow.compute as pc
    size, start = size or IDS_AT_A_TIME, 0
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _decoded(df: DataFrame, vocab: DataFrame, ids: str, skip: list[int], last: bool) -> DataFrame:
    """``df`` with the tokens of one shard put in their places."""
    pairs = vocab.toArrow().sort_by("id")
    sent = df.sparkSession.sparkContext.broadcast((pairs["id"].to_numpy().astype("int64"), pairs["token"].combine_chunks()))
    columns = df.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        keys, tokens = sent.value
        for b in (piece for whole in batches for piece in _pieces(whole, columns.index(ids))):
            lists, had = b.column(columns.index(ids)), b.column(columns.index("_tokens"))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            found = keys[place] == flat if len(keys) else np.zeros(len(flat), bool)
            text = tokens.take(pa.array(np.where(found, place, 0), mask=~found)) if len(keys) else pa.nulls(len(flat), pa.string())
            if had.null_count < len(had):  # of an earlier shard; the same rows have them
                text = pc.coalesce(had.flatten(), text)
            if last:
                unknown = pc.is_null(text)
                if pc.any(unknown).as_py():
                    text = pc.replace_with_mask(text, unknown, pa.array([f"<unk:{i}>" for i in flat[unknown.to_numpy(zero_copy_only=False)]], pa.string()))
                text = pc.if_else(pa.array(np.isin(flat, skip)), pa.scalar(None, pa.string()), text)
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            cols = list(b.columns)
            cols[columns.index("_tokens")] = pa.ListArray.from_arrays(pa.array(ends), text)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return df.mapInArrow(run, df.schema)
