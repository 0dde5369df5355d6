"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at most 2 - 2c apart, squared.  A
fixed rotation spreads the components evenly; the rotated vector is split
into ``BLOCKS`` blocks, and in at least one of them two linked vectors are
within 1 / BLOCKS of that budget.  Each block is joined by range: a grid over
its first ``GRID`` coordinates, cells twice as wide as the block's distance,
each point probing the neighbour cells that it lies near (each pair of cells
is met from one side only), then the squared block distance.  The union of all
blocks' candidates is verified by the cosine of the vectors as given, in
double precision.

Equal vectors of a label are one class with a count, so copies are not paired
with each other; links between different vectors are never dropped.  A large
cell is a skewed key of a sort-merge join, which AQE splits.

Defined results: rows with a null label or id, vectors that are null, zero or
hold null or non-finite components link with nothing (a row with a null id has
a null component and is not kept); vectors of different length do not link;
rows repeated with the same id count as vectors of their own.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import components, saved

COSINE = 0.98
BLOCKS = 8
GRID = 4
SEED = 8
#: room for rounding in the rotated coordinates; verification is exact
SLACK = 1e-6


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))[0]


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def cells(classes: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """A row for each class, block and probed cell: ``label, d, block, cell,
    home, id`` and the block's coordinates ``x``."""
    def run(batches):
        turned: dict[int, np.ndarray] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                class_id, label, vec = row
                v = np.array(vec)
                v = v / np.abs(v).max()
                d = len(v)
                if d not in turned:
                    turned = {d: rotation(d)}
                x = turned[d] @ (v / np.linalg.norm(v))
                out = {k: [] for k in names}
                for k, part in enumerate(np.array_split(x, min(blocks, d))):
                    radius = math.sqrt((2 - 2 * cosine) / min(blocks, d) + SLACK)
                    g = part[:GRID] / (2 * radius)
                    home = np.floor(g).astype(int)
                    side = np.where(g - home < 0.5, -1, 1)
                    for step in itertools.product((0, 1), repeat=len(g)):
                        cell = tuple(int(c) for c in home + side * np.array(step))
                        if cell >= tuple(home):
                            out["label"].append(label)
                            out["d"].append(d)
                            out["block"].append(k)
                            out["cell"].append(",".join(map(str, cell)))
                            out["home"].append(not any(step))
                            out["id"].append(class_id)
                            out["x"].append(part.tolist())
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    names = ["label", "d", "block", "cell", "home", "id", "x"]
    schema = pa.schema(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.float64())]))
    return classes.select("id", "label", "embedding").mapInArrow(
        run, "label long, d int, block int, cell string, home boolean, id long, x array<double>")


def candidate_pairs(classes: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """Distinct pairs ``(a, b)`` of class ids that are near in some block."""
    width = classes.select(F.max(F.size("embedding"))).first()[0] or 1
    most = -(-width // min(blocks, width))
    grid = cells(classes, cosine, blocks)
    grid = saved(grid.select("label", "d", "block", "cell", "home", "id",
                             *(F.coalesce(F.get("x", F.lit(k)), F.lit(0.0)).alias(f"x{k}") for k in range(most))), "cells")
    gap = sum(((F.col(f"p.x{k}") - F.col(f"q.x{k}")) * (F.col(f"p.x{k}") - F.col(f"q.x{k}")) for k in range(most)), F.lit(0.0))
    budget = (2 - 2 * cosine) / F.least(F.lit(blocks), F.col("p.d")) + SLACK
    same = F.col("p.home") & (F.col("p.id") < F.col("q.id")) | ~F.col("p.home")
    key = ["label", "d", "block", "cell"]
    on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in key]
    met = grid.alias("p").join(grid.where("home").alias("q"), [*on, same, gap <= budget])
    return met.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def verify(pairs: DataFrame, classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    vec = classes.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    both = (pairs.join(vec.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
            .join(vec.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return both.where(dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))) >= cosine).select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, vec_id: str = "vec_id",
                    embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(embedding).alias("embedding"))
    good = base.where(_usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # one vec_id may stand for several vectors, so classes get numbers of their own
    numbered = saved(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
                     .withColumn("id", F.monotonically_increasing_id()), "classes")
    links = saved(verify(candidate_pairs(numbered, cosine, blocks), numbered, cosine), "links")
    copies = numbered.select("id", "copies", "first")
    ends = links.union(links.select("b", "a")).toDF("id", "other")
    degree = ends.join(copies.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("far"))
    first = lambda c: copies.select(F.col("id").alias(c), F.col("first").alias(f"{c}_first"))
    edges = links.join(first("a"), "a").join(first("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    members = good.join(numbered.select("label", "embedding", "id", "copies", "first"), ["label", "embedding"])
    # a repeated id ties the classes that it stands in
    ties = members.where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    part = components(edges.union(ties))
    state = numbered.join(degree, "id", "left").select("label", "embedding", "first", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    state = state.join(part.select(F.col("id").alias("first"), "component"), "first", "left")
    linked = good.join(state, ["label", "embedding"]).select("vec_id", "n_links", F.coalesce("component", "first").alias("component_id"))
    alone = (base.where(~(_usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
