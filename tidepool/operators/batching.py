"""Batching operators (A7–A10, A14) and sequence validations (V1, V2).

A batch is a group of ``batch_size`` consecutive rows in a given order; the
batch id comes from an exact distributed rank (``split.global_rank``).  Per
batch quantities (longest row, BOS rule, truncation draw) are window
aggregates over ``batch_id`` — bounded by the batch size, so no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.rand import hash52, uniform, uniform_int
from tidepool.operators.split import global_rank
from tidepool.session import scratch_path

IGNORE = -100


def _pad(c: Column, n: Column, value) -> Column:
    return F.concat(c, F.array_repeat(F.lit(value).cast("bigint"), F.greatest(n, F.lit(0))))


def assign_batches(df: DataFrame, batch_size: int, order: Column, key: str) -> DataFrame:
    """``batch_id`` and ``row_in_batch`` from the exact rank in ``order``."""
    r = global_rank(df, order, F.col(key), out="_rank")
    return (r.withColumn("batch_id", F.floor(F.col("_rank") / batch_size).cast("bigint"))
            .withColumn("row_in_batch", (F.col("_rank") % batch_size).cast("int"))
            .drop("_rank"))


def collate(df: DataFrame, pad_id: int, label_pad_id: int = IGNORE, batch_key: str = "batch_id",
            with_attention: bool = True) -> DataFrame:
    """Pad every row to the longest row of its batch; labels padded with
    ``label_pad_id`` (-100 by default; chat training passes the pad id so the
    padded EOS is learned); attention mask 1 on real tokens, 0 on padding."""
    w = Window.partitionBy(batch_key)
    df = df.withColumn("_len", F.size("input_ids")).withColumn("_max", F.max("_len").over(w))
    n = F.col("_max") - F.col("_len")
    df = df.withColumn("input_ids", _pad(F.col("input_ids"), n, pad_id))
    if "labels" in df.columns:
        df = df.withColumn("labels", _pad(F.col("labels"), n, label_pad_id))
    if with_attention:
        df = df.withColumn("attention_mask", F.concat(
            F.array_repeat(F.lit(1).cast("bigint"), F.col("_len")),
            F.array_repeat(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0)))))
    return df.drop("_len", "_max")


def batch_collate(df: DataFrame, batch_size: int, key: str, seed: int, pad_id: int,
                  label_pad_id: int = IGNORE) -> DataFrame:
    """Shuffled batches: order by hash52(seed:key), cut into batches, pad."""
    b = assign_batches(df, batch_size, hash52(seed, F.col(key)), key)
    return collate(b, pad_id, label_pad_id)


def length_bucket(df: DataFrame, batch_size: int, key: str, seed: int, bucket_width: int,
                  pad_id: int, label_pad_id: int = IGNORE) -> DataFrame:
    """A10: length-grouped batching — bucket rows by ``size // width``,
    order inside a bucket by hash, cut into batches, pad (A8).  The order needs
    the lengths, and with them the ids, so rows are written once before they
    are ranked."""
    bucket = F.floor(F.size("input_ids") / bucket_width).cast("long")
    order = F.col("length_bucket") * F.lit(1 << 40) + F.shiftright(hash52(seed, F.col(key)), 12)
    rows, path = df.withColumn("length_bucket", bucket), scratch_path(df.sparkSession, "lengths")
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    return collate(assign_batches(rows, batch_size, order, key), pad_id, label_pad_id)


def align_block(df: DataFrame, block_size: int, eos_id: int) -> DataFrame:
    """Pad ids *and labels* with EOS up to a multiple of ``block_size``
    (labels are trained on EOS); aligned rows are untouched."""
    n = F.pmod(-F.size("input_ids"), F.lit(block_size))
    df = df.withColumn("input_ids", _pad(F.col("input_ids"), n, eos_id))
    if "labels" in df.columns:
        df = df.withColumn("labels", _pad(F.col("labels"), F.pmod(-F.size("labels"), F.lit(block_size)), eos_id))
    return df


def random_truncate(df: DataFrame, seed: int, ratio: float = 0.01, batch_key: str = "batch_id",
                    label_pad_id: int = IGNORE) -> DataFrame:
    """With probability ``ratio`` per batch, draw one length in [1, L]
    (L = the batch's padded length) and zero the attention mask and set
    labels to -100 after it; ids untouched."""
    L = F.size("input_ids")
    hit = uniform(seed, F.lit("trunc"), F.col(batch_key)) < F.lit(ratio)
    cut = F.when(hit, uniform_int(seed, 1, L, F.lit("len"), F.col(batch_key))).otherwise(L)
    df = df.withColumn("_cut", cut)
    if "attention_mask" not in df.columns:
        df = df.withColumn("attention_mask", F.array_repeat(F.lit(1).cast("bigint"), L))
    df = df.withColumn("attention_mask", F.transform("attention_mask",
                                                     lambda x, i: F.when(i < F.col("_cut"), x).otherwise(F.lit(0).cast("bigint"))))
    if "labels" in df.columns:
        df = df.withColumn("labels", F.transform("labels", lambda x, i: F.when(i < F.col("_cut"), x)
                                                 .otherwise(F.lit(label_pad_id).cast("bigint"))))
    return df.withColumn("truncated_at", F.when(hit, F.col("_cut"))).drop("_cut")


def prompt_batch_right(df: DataFrame, max_new_tokens: int, mask_id: int, eos_id: int,
                       batch_key: str = "batch_id", ids: str = "prompt_ids") -> DataFrame:
    """A14(a): canvas of width T = max(prompt_len in batch) + max_new_tokens:
    prompt, then ``max_new_tokens`` masks, EOS fill; attention 1 up to
    ``min(prompt_len + max_new_tokens, T)``."""
    pl = F.size(ids)
    T = F.max(pl).over(Window.partitionBy(batch_key)) + F.lit(max_new_tokens)
    df = df.withColumn("_T", T).withColumn("_pl", pl)
    canvas = F.concat(F.col(ids), F.array_repeat(F.lit(mask_id).cast("bigint"), F.lit(max_new_tokens)),
                      F.array_repeat(F.lit(eos_id).cast("bigint"), F.col("_T") - F.col("_pl") - F.lit(max_new_tokens)))
    valid = F.least(F.col("_pl") + F.lit(max_new_tokens), F.col("_T"))
    att = F.concat(F.array_repeat(F.lit(1).cast("bigint"), valid),
                   F.array_repeat(F.lit(0).cast("bigint"), F.col("_T") - valid))
    return df.withColumn("canvas", canvas).withColumn("attention_mask", att).drop("_T", "_pl")


def prompt_batch_left(df: DataFrame, block_size: int, pad_id: int, batch_key: str = "batch_id",
                      ids: str = "prompt_ids") -> DataFrame:
    """A14(b): left-pad prompts to the batch's longest prompt rounded up to a
    multiple of ``block_size``; attention 0 on the pads."""
    pl = F.size(ids)
    mx = F.max(pl).over(Window.partitionBy(batch_key))
    width = F.ceil(mx / F.lit(block_size)) * F.lit(block_size)
    df = df.withColumn("_w", width.cast("int")).withColumn("_pl", pl)
    n = F.col("_w") - F.col("_pl")
    return (df.withColumn("canvas", F.concat(F.array_repeat(F.lit(pad_id).cast("bigint"), n), F.col(ids)))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(0).cast("bigint"), n),
                                                   F.array_repeat(F.lit(1).cast("bigint"), F.col("_pl"))))
            .drop("_w", "_pl"))


# ------------------------------------------------------------- validation

def label_violations(df: DataFrame, ids: str = "input_ids", labels: str = "labels") -> Column:
    """V1 predicate: ids and labels differ in length, or at some position the
    label is not -100 and not the id.  Never null: a missing value is a
    violation."""
    pairs = F.arrays_zip(F.col(ids).alias("x"), F.col(labels).alias("y"))
    wrong = F.exists(pairs, lambda p: ~p["y"].eqNullSafe(F.lit(IGNORE)) & ~p["y"].eqNullSafe(p["x"]))
    return F.coalesce((F.size(ids) != F.size(labels)) | wrong, F.lit(True))


def too_long(max_length: int, context: str = "context_ids", continuation: str = "continuation_ids") -> Column:
    """V2 predicate: context and continuation together exceed ``max_length``."""
    return F.size(context) + F.size(continuation) > max_length
