"""Packing token sequences into fixed-length chunks (A2, A3).

The reference concatenates the sequences of a map batch of 1,000 rows and cuts
the result into ``seq_length`` chunks, losing a tail per batch.  Here the batch
is an explicit ``pack_group``: the exact position of the row in key order
divided by ``group_size``, so a group holds that many rows whatever the keys
look like (dense, strided, hashed; rows with a null key come last).  Tokens are
never exploded:

1. a window prefix sum of ``size(ids)`` inside the group, ordered by key, gives
   every sequence's [start, end) token offsets;
2. each sequence is cut into one slice for each chunk that it overlaps, and the
   slices are exploded, so no row carries the whole sequence more than once;
3. slices meet per (group, chunk) and are concatenated in key order.

The aggregation reuses the window's partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.split import global_rank
from tidepool.operators.tokens import append_eos


def assign_pack_group(df: DataFrame, key: str, group_size: int = 1000,
                      out: str = "pack_group") -> DataFrame:
    """Number the groups of ``group_size`` rows in the order of ``key``
    (integral).  Best done before tokens are made, on the narrower rows."""
    ranked = global_rank(df, F.col(key), F.col(key), "_rank")
    return ranked.withColumn(out, F.floor(F.col("_rank") / F.lit(group_size)).cast("bigint")).drop("_rank")


def pack(df: DataFrame, seq_length: int, key: str = "doc_id", ids: str = "input_ids",
         group_col: str = "pack_group", group_size: int = 1000, drop_tail: bool = True,
         eos_id: int | None = None) -> DataFrame:
    """A2/A3: chunks ``(pack_group, chunk_id, input_ids, labels)``.

    ``eos_id`` appends EOS to every sequence unless it already ends with it
    (the reference's ``insert_eos``).  ``drop_tail`` drops the incomplete last
    chunk of every group; otherwise it is kept short.  A null sequence counts
    as an empty one.
    """
    size = int(seq_length)
    if group_col not in df.columns:
        df = assign_pack_group(df, key, group_size, group_col)
    df = df.select(group_col, key, F.coalesce(F.col(ids), F.array().cast("array<bigint>")).alias("_ids"))
    if eos_id is not None:
        df = append_eos(df, eos_id, "_ids")
    w = Window.partitionBy(group_col).orderBy(F.col(key).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off = (df.withColumn("_n", F.size("_ids").cast("bigint")).withColumn("_end", F.sum("_n").over(w))
           .withColumn("_start", F.col("_end") - F.col("_n")))
    first, last = F.floor(F.col("_start") / size).cast("bigint"), F.floor((F.col("_end") - 1) / size).cast("bigint")

    def piece(c):
        lo, hi = F.greatest(F.col("_start"), c * size), F.least(F.col("_end"), (c + 1) * size)
        return F.struct(c.alias("chunk_id"), F.slice("_ids", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("p"))

    cut = F.when(F.col("_n") > 0, F.transform(F.sequence(first, F.greatest(first, last)), piece))
    pieces = (off.select(group_col, key, "_start", F.explode(cut).alias("c"))
              .select(group_col, F.col("c.chunk_id").alias("chunk_id"), F.struct("_start", F.col("c.p").alias("p")).alias("s")))
    chunks = (pieces.groupBy(group_col, "chunk_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
              .select(group_col, "chunk_id", F.flatten(F.col("s.p")).alias("input_ids")))
    if drop_tail:
        chunks = chunks.where(F.size("input_ids") == size)
    return chunks.withColumn("labels", F.col("input_ids"))
