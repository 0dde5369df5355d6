"""Merkle manifest of a dataset by bitmap ranks and keyed slot arrays.

*Coordinates.*  The keys of each group are merged into compressed bitmaps:
64-bit words are made by partial aggregation, only words that are not zero are
kept, and up to 1,024 of them form the container of 65,536 neighbouring keys,
together with the number of bits before each.  Three directories above the
containers (by 16 bits of the key each) hold the counts before each child.  The
rank of a key is the sum of these counts and of the bits before its own, so no
leaf is sorted and no window is wider than 65,536 rows of a directory.

*Levels.*  Leaves go by rank to slot arrays of ``3 ** levels`` leaves, keyed by
group and block; a task takes an array up that many levels at once.  The block digests are
the leaves of the next round, until one is left in each group.  On the way back
each block gets the path of its own digest and hands it on to its slots.

Defined results: null keys come before all others; rows of a group with one
key follow the first eight bytes of their leaves, and equal rows take places
next to each other; a null group comes before all others; null fields are
``-``; an empty table gives no rows.  No array grows with a group, a repeated
key or the number of groups.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import in_batches, saved, small

ARITY = 3
#: Levels that one slot array takes (729 leaves).
LEVELS = 6
#: Paths (of at most a few KB each) that may be broadcast, if counted.
PATHS = 10_000
PATH = "array<struct<left: string, right: string>>"


def field(c: str | Column) -> Column:
    """A value as its UTF-8 length, a colon and its text; null as ``-``."""
    c = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(*fields: str | Column) -> Column:
    """The digest of a row, in hex."""
    return F.sha2(F.concat(*map(field, fields)), 256)


# ------------------------------------------------------------------- ranks

def _containers(rows: DataFrame, by: list[str]) -> DataFrame:
    """``words, bits, before`` of each ``by, hi``; ``n`` rows, ``ids`` bits."""
    words = rows.groupBy(*by, "hi", F.shiftright("low", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(low & 63 AS INT))")).alias("b"), F.count(F.lit(1)).alias("n"))
    ones = F.bit_count("b").cast("int")
    before = F.sum(ones).over(Window.partitionBy(*by, "hi").orderBy("w")) - ones
    words = words.withColumn("before", before.cast("int"))
    list_ = words.groupBy(*by, "hi").agg(F.sort_array(F.collect_list(F.struct("w", "b", "before"))).alias("c"),
                                         F.sum("n").alias("n"), F.sum(ones).cast("long").alias("ids"))
    return list_.select(*by, "hi", F.col("c.w").alias("words"), F.col("c.b").alias("bits"), F.col("c.before").alias("before"), "n", "ids")


def _offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by, hi, first, total``: the rows of a group before a container, and
    all of them.  One directory for each 16 bits of ``hi``."""
    levels = [counts.select(*by, F.col("hi").alias("k0"), "n")]
    for k in (1, 2):
        up = F.shiftright(f"k{k - 1}", 16).alias(f"k{k}")
        levels.append(levels[-1].groupBy(*by, up).agg(F.sum("n").alias("n")))
    out = None
    for k in (2, 1, 0):
        own = levels[k] if k == 2 else levels[k].withColumn(f"k{k + 1}", F.shiftright(f"k{k}", 16))
        parent = by if k == 2 else [*by, f"k{k + 1}"]
        before = F.sum("n").over(Window.partitionBy(*parent).orderBy(f"k{k}")) - F.col("n")
        own = own.withColumn("at", before)
        if k == 2:
            out = own.withColumn("total", F.sum("n").over(Window.partitionBy(*by))).select(*by, "k2", F.col("at").alias("first"), "total")
        else:
            out = own.join(out, parent).select(*by, f"k{k}", (F.col("first") + F.col("at")).alias("first"), "total")
    return out.withColumnRenamed("k0", "hi")


def ranks(rows: DataFrame, by: list[str], value: str) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` (how many of the group have a smaller value),
    ``tied`` (others have the same) and ``total`` (rows of the group), and the
    number of rows that repeat a value.  ``value`` is a long; null is least."""
    v = F.col(value)
    keyed = rows.withColumn("hi", F.coalesce(F.shiftright(v, 16), F.lit(-(1 << 47) - 1))).withColumn(
        "low", F.coalesce(v.bitwiseAND(F.lit(0xFFFF)), F.lit(0)).cast("int"))
    boxes = saved(_containers(keyed, by), "bitmaps")
    more = boxes.agg(F.sum(F.col("n") - F.col("ids"))).first()[0] or 0
    boxes = boxes.join(_offsets(boxes, by), [*by, "hi"])
    key = [*by, "hi"]
    if more:
        again = boxes.where("n > ids").select(*key)
        again = keyed.join(again, key, "left_semi").groupBy(*key, "low").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")
        again = again.groupBy(*key).agg(F.collect_list(F.struct("low", "extra")).alias("extras"))
        boxes = boxes.join(again, key, "left")
    else:
        boxes = boxes.withColumn("extras", F.lit(None).cast("array<struct<low: int, extra: bigint>>"))
    boxes = boxes.select(*key, "words", "bits", "before", "extras", "first", "total")
    at = F.array_position("words", F.shiftright("low", 6)).cast("int")
    under = F.expr("bits[at - 1] & ~shiftleft(-1L, CAST(low & 63 AS INT))")
    found = keyed.join(boxes, key).withColumn("at", at)
    smaller = F.aggregate(F.coalesce("extras", F.array()), F.lit(0).cast("long"),
                          lambda n, x: n + F.when(x["low"] < F.col("low"), x["extra"]).otherwise(0))
    found = found.withColumn("rank", F.col("first") + F.expr("before[at - 1]") + F.bit_count(under) + smaller)
    found = found.withColumn("tied", F.exists(F.coalesce("extras", F.array()), lambda x: x["low"] == F.col("low")))
    return found.select(*rows.columns, "rank", "tied", "total"), more


def places(rows: DataFrame) -> DataFrame:
    """``rows(g, key, digest, uid, …)`` with ``p``, the place of each row in
    its group, and ``total``.  Rows with one key are ranked again by the first
    bytes of their digest, then by ``uid``, which is unique."""
    first = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    rows = rows.withColumn("_d", first.bitwiseXOR(F.lit(-(1 << 63))))  # as an unsigned number sorts
    out, left, by, cols = None, rows.withColumn("_off", F.lit(0).cast("long")).withColumn("_all", F.lit(None).cast("long")), ["g"], rows.columns
    for value in ("key", "_d", "uid"):
        got, more = ranks(left, by, value)
        got = got.withColumn("_off", F.col("_off") + F.col("rank")).withColumn("_all", F.coalesce("_all", "total"))
        got = got.drop("rank", "total")
        done = (got.where("not tied") if more else got).select(*cols, F.col("_off").alias("p"), F.col("_all").alias("total"))
        out = done if out is None else out.unionByName(done)
        if not more:
            break
        # ties: the offset names a group and a value, and null needs no care
        by = ["g", "_off"]
        left = saved(got.where("tied").drop("tied"), "ties")
    return out.drop("_d", "uid")


# ------------------------------------------------------------------ levels

def _height(n: int) -> int:
    """Levels until one of ``n`` nodes is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def _up(nodes: list[str], total: int, levels: int) -> list[list[str]]:
    """The levels above some nodes of a group that has ``total`` of them."""
    out = [nodes]
    for _ in range(min(levels, _height(total))):
        low = out[-1]
        out.append([sha256("".join(low[i:i + ARITY]).encode()).hexdigest() for i in range(0, len(low), ARITY)])
    return out


def _slots(cell) -> tuple[np.ndarray, list[str]]:
    """The order of a block's slots, and their digests in it."""
    order = np.argsort(cell.field("slot").to_numpy(zero_copy_only=False), kind="stable")
    return order, [d.hex() for d in cell.field("digest").take(pa.array(order)).to_pylist()]


def _roots(levels: int):
    """A map from blocks to their digests."""
    def run(batches):
        for b in batches:
            slots, tops = b.column(3), []
            for i, total in enumerate(b.column(2).to_pylist()):
                tops.append(bytes.fromhex(_up(_slots(slots[i].values)[1], total, levels)[-1][0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tops, pa.binary())], ["g", "block", "total", "digest"])
    return run


def _blocks(rows: DataFrame, payload: list[str], levels: int) -> DataFrame:
    """Slot arrays of ``rows(g, p, total, digest, payload…)``."""
    size = ARITY ** levels
    slot = F.struct((F.col("p") % size).cast("int").alias("slot"), "digest", *payload)
    return saved(rows.groupBy("g", F.expr(f"p div {size}").alias("block"))
                 .agg(F.max("total").alias("total"), F.collect_list(slot).alias("slots")), "slots")


def build(rows: DataFrame, payload: list[str], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every round, and ``g, digest``: the roots."""
    size, stages = ARITY ** levels, [_blocks(rows, payload, levels)]
    most = stages[0].agg(F.max("total")).first()[0] or 0
    while True:
        nodes = saved(in_batches(stages[-1].select("g", "block", "total", "slots")).mapInArrow(_roots(levels), "g string, block long, total long, digest binary"), "nodes")
        if most <= size:
            return stages, nodes.select("g", "digest")
        most = -(-most // size)
        rows = nodes.select("g", F.col("block").alias("p"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), "digest")
        stages.append(_blocks(rows, [], levels))


def _lengthen(schema, payload: list[str], levels: int):
    """A map from blocks with the path of their digest to their slots."""
    def run(batches):
        for b in batches:
            slots, ups = b.column(3), b.column(5)
            totals, blocks = b.column(2).to_pylist(), b.column(1).to_pylist()
            for i in range(b.num_rows):
                cell = slots[i].values
                order, nodes = _slots(cell)
                tree = _up(nodes, totals[i], levels)
                up = ups[i].as_py()
                above_left, above_right = [x["left"] for x in up], [x["right"] for x in up]
                left, right = [], []
                for s in range(len(order)):
                    for low in tree[:-1]:
                        run_ = s - s % ARITY
                        left.append("".join(low[run_:s]))
                        right.append("".join(low[s + 1:run_ + ARITY]))
                        s //= ARITY
                    left += above_left
                    right += above_right
                ends = np.arange(len(order) + 1, dtype=np.int32) * (len(tree) - 1 + len(up))
                path = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
                take, n = pa.array(order), len(order)
                cols = [pa.array([b.column(0)[i].as_py()] * n, pa.string()), pa.array(blocks[i] * ARITY ** levels + np.arange(n)), cell.field("digest").take(take),
                        pa.array([b.column(4)[i].as_py()] * n, pa.binary()), *(cell.field(c).take(take) for c in payload), path]
                yield pa.RecordBatch.from_arrays(cols, names=schema)
    return run


def paths(stages: list[DataFrame], up: DataFrame, payload: list[str], levels: int) -> DataFrame:
    """``g, p, digest, top, payload…, path`` of every leaf; ``up(g, top, path)``
    has each group's root and the path above it."""
    up = up.withColumn("p", F.lit(0).cast("long"))
    for k in range(len(stages) - 1, -1, -1):
        own = payload if k == 0 else []
        kinds = {f.name: f.dataType.simpleString() for f in stages[k].schema["slots"].dataType.elementType.fields}
        schema = "g string, p long, digest binary, top binary, " + "".join(f"{c} {kinds[c]}, " for c in own) + f"path {PATH}"
        above = small(up.select(F.col("g"), F.col("p").alias("block"), "top", "path"), PATHS)
        blocks = stages[k].join(above, ["g", "block"]).select("g", "block", "total", "slots", "top", "path")
        names = ["g", "p", "digest", "top", *own, "path"]
        up = in_batches(blocks).mapInArrow(_lengthen(names, own, levels), schema)
        if k:
            up = saved(up.select("g", "p", "top", "path"), "paths")
    return up


# ---------------------------------------------------------------- manifest

def manifest(leaves: DataFrame, payload: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """The manifest of ``leaves(grp string, key long, leaf hex string)`` and
    further columns that are kept as they are: ``grp, key, leaf, subroot, root``
    in hex, ``place`` in the group, and ``path``, the siblings to the left and
    to the right on every level up to the root."""
    kept = list(payload)
    own = [f"c{i}" for i in range(len(kept))]
    # a group's name that sorts as the groups do, null first, and is not null
    rows = leaves.select(F.coalesce(F.concat(F.lit(":"), "grp"), F.lit("-")).alias("g"), F.col("key").cast("long").alias("key"),
                         F.unhex("leaf").alias("digest"), F.monotonically_increasing_id().alias("uid"),
                         *(F.col(c).alias(o) for c, o in zip(kept, own)))
    rows = saved(rows, "leaves")
    carried = ["key", *own]
    stages, subroots = build(places(rows), carried, levels)

    # the groups are the leaves of one more tree
    order = saved(subroots.orderBy("g").select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", F.monotonically_increasing_id().alias("at")), "groups")
    ranked = ranks(order, ["g"], "at")[0].select("g", "name", "digest", F.col("rank").alias("p"), "total")
    above, root = build(ranked, ["name"], levels)
    top = root.first()
    root = F.lit(top["digest"].hex() if top else None).cast("string")
    start = root_path(leaves.sparkSession)
    up = saved(paths(above, start, ["name"], levels).select(F.col("name").alias("g"), F.col("digest").alias("top"), "path"), "paths")
    out = paths(stages, up, carried, levels)
    return out.select(F.expr("CASE WHEN g <> '-' THEN substring(g, 2) END").alias("grp"), "key", F.lower(F.hex("digest")).alias("leaf"),
                      F.lower(F.hex("top")).alias("subroot"), root.alias("root"), F.col("p").alias("place"), "path",
                      *(F.col(o).alias(c) for c, o in zip(kept, own)))


def root_path(spark) -> DataFrame:
    """The path above the root: none."""
    return spark.createDataFrame([("", None, [])], f"g string, top binary, path {PATH}")


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))
