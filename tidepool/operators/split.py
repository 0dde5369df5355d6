"""Splits, limits, ordering and set operations.

Exact first-n selections are cuts (``cuts.py``): all ranks that an operator
needs are found in shared passes, and the selection is a filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.permute import domain, permuted, round_keys
from tidepool.functions.rand import hash52
from tidepool.operators.cuts import BUCKETS, Cuts, Part, rank_cut, row_hash
from tidepool.session import scratch_path


def first_n(df: DataFrame, n: int, order_by: str, *ties: str) -> DataFrame:
    """The first ``n`` rows by an integral column.  Rows with one value
    follow the tiebreaks, then a hash of the row."""
    part, cut = rank_cut(df, F.col(order_by), *ties, row_hash(df), n=n)
    return df.where(part.within(cut))


@dataclass
class Unsplit:
    """Rows whose exact train/test split is still to be cut, so that a loader
    of several sources finds all cuts together; ``then`` follows the split."""

    df: DataFrame
    key: str
    test_size: float | int = 0.05
    seed: int = 42
    then: Callable[[DataFrame], DataFrame] = lambda df: df

    def part(self) -> Part:
        return Part(self.df, hash52(self.seed, F.col(self.key)), (F.col(self.key), row_hash(self.df)))

    @property
    def want(self) -> float | int:
        return self.test_size if isinstance(self.test_size, float) else int(self.test_size)


def split_all(frames: list[Unsplit], split_col: str = "split") -> list[DataFrame]:
    """L1 for several sources in the same passes."""
    parts = {str(k): u.part() for k, u in enumerate(frames)}
    cuts = Cuts(parts).find({(str(k), ""): [u.want] for k, u in enumerate(frames)})
    out = []
    for k, u in enumerate(frames):
        is_test = parts[str(k)].within(cuts[str(k), "", u.want])
        out.append(u.then(u.df.withColumn(split_col, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))))
    return out


def split_exact(df: DataFrame, key: str, test_size: float = 0.05, seed: int = 42,
                split_col: str = "split") -> DataFrame:
    """L1: seeded train/test split with an exact test size ``ceil(frac * n)``.

    Rows are ranked by ``hash52(seed:key)`` — deterministic, independent of
    partitioning — and the lowest ranks form the test split.  Membership
    differs from the reference's RNG; size and determinism hold.
    """
    return split_all([Unsplit(df, key, test_size, seed)], split_col)[0]


def limit_all(frames: list[tuple[DataFrame, dict]], order_by: str, split_col: str = "split",
              overlapping: bool = True) -> list[DataFrame]:
    """L2 and L3 for several sources in the same passes: each frame with its
    limits by split.  Of a frame with one split, every requested split is cut
    from the start of the same rows (L3; not without ``overlapping``)."""
    parts = {str(k): Part(df, F.col(order_by), (row_hash(df),), F.col(split_col)) for k, (df, limits) in enumerate(frames) if limits}
    cuts = Cuts(parts)
    splits = {k: [g for s, g in cuts.groups if s == k] for k in parts}
    lone = {k: g[0] for k, g in splits.items() if overlapping and len(g) == 1}
    wants = {}
    for k in parts:
        limits = frames[int(k)][1]
        for name, n in limits.items():
            if n is not None and not isinstance(n, int):
                raise ValueError(f"split {name!r}: a row count is needed, not {n!r}")
            if n is not None:
                wants.setdefault((k, lone.get(k, name)), []).append(n)
    found = cuts.find(wants)
    out = []
    for number, (df, limits) in enumerate(frames):
        k = str(number)
        limits = {name: n for name, n in limits.items() if n is not None}
        if k not in parts or not limits:
            out.append(df)
        elif k in lone:
            cut = [df.where(parts[k].within(found[k, lone[k], n])).withColumn(split_col, F.lit(name)) for name, n in limits.items()]
            out.append(_union_all(cut, df))
        else:
            keep = ~F.coalesce(F.col(split_col).isin(list(limits)), F.lit(False))
            for name, n in limits.items():
                keep = keep | F.coalesce((F.col(split_col) == name) & parts[k].within(found[k, name, n]), F.lit(False))
            out.append(df.where(keep))
    return out


def limit_split(df: DataFrame, limits: dict, order_by: str, split_col: str = "split") -> DataFrame:
    """L2: first-n per split (by ``order_by``); splits that are not named and
    rows without a split stay whole; limits naming absent splits do nothing;
    bigger n is harmless.  One filter over the rows as they lie."""
    return limit_all([(df, limits)], order_by, split_col, overlapping=False)[0]


def derive_splits_overlapping(df: DataFrame, limits: dict, order_by: str,
                              split_col: str = "split") -> DataFrame:
    """L3 (batch, one-split source): every requested split is cut from the
    start of the same rows, so splits overlap — the reference's behaviour.
    Non-integer limits (leftover text options) are rejected."""
    return limit_all([(df.withColumn(split_col, F.lit("train")), limits)], order_by, split_col)[0]


def derive_splits_disjoint(df: DataFrame, n_train: int | None, n_test: int | None,
                           order_by: str, split_col: str = "split") -> DataFrame:
    """L4 (the streaming loader's semantics, batch form): test = first
    ``n_test`` rows, train = the next ``n_train``; disjoint.  With one limit
    only, that split is taken from the start."""
    if n_train is None and n_test is None:
        return df
    part = Part(df, F.col(order_by), (row_hash(df),))
    if n_train is not None and n_test is not None:
        found = Cuts({"": part}).find({("", ""): [n_test, n_test + n_train]})
        first, both = part.within(found["", "", n_test]), part.within(found["", "", n_test + n_train])
        return df.where(both).withColumn(split_col, F.when(first, F.lit("test")).otherwise(F.lit("train")))
    name, n = ("train", n_train) if n_train is not None else ("test", n_test)
    return df.where(part.within(Cuts({"": part}).find({("", ""): [n]})["", "", n])).withColumn(split_col, F.lit(name))


def derive_splits_named(df: DataFrame, n_train: int | None, n_test: int | None,
                        order_by: str, split_col: str = "split") -> DataFrame:
    """L4 for multi-split sources: the named split must exist (error)."""
    part = Part(df, F.col(order_by), (row_hash(df),), F.col(split_col))
    cuts = Cuts({"": part})
    limits = {name: n for name, n in (("train", n_train), ("test", n_test)) if n is not None}
    for name in limits:
        if ("", name) not in cuts.groups:
            raise ValueError(f"the source has no {name!r} split to limit")
    found = cuts.find({("", name): [n] for name, n in limits.items()})
    keep = F.lit(False)
    for name, n in limits.items():
        keep = keep | F.coalesce((F.col(split_col) == name) & part.within(found["", name, n]), F.lit(False))
    return df.where(keep)


def shuffle(df: DataFrame, key: str, seed: int = 42, epoch: int | Column = 0,
            out: str = "shuffle_key", sort: bool = True) -> DataFrame:
    """Seeded shuffle = order by hash52(seed:epoch:key).  Stable under any
    partitioning (``rand(seed)`` is not).  ``sort`` range-partitions the data;
    without it only the key column is added."""
    ep = epoch if isinstance(epoch, Column) else F.lit(epoch)
    res = df.withColumn(out, hash52(seed, ep, F.col(key)))
    return res.orderBy(out, key) if sort else res


# ---------------------------------------------------------------- set ops

def _union_all(parts, like: DataFrame) -> DataFrame:
    if not parts:
        return like.limit(0)
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p, allowMissingColumns=True)
    return res


def concat_splits(a: DataFrame | None, b: DataFrame | None, source_col: str | None = None,
                  sources=("a", "b")) -> DataFrame:
    """UNION ALL of two parts; the same object is not doubled; a missing
    side passes through."""
    if a is b or b is None:
        return a
    if a is None:
        return b
    if source_col:
        a = a.withColumn(source_col, F.lit(sources[0]))
        b = b.withColumn(source_col, F.lit(sources[1]))
    return a.unionByName(b, allowMissingColumns=True)


def merge_splits(parts) -> DataFrame:
    """Merge split maps.  With a ``split`` column this is one UNION ALL:
    splits present in either part appear, shared splits are concatenated."""
    parts = [p for p in parts if p is not None]
    return _union_all(parts, parts[0]) if parts else None


def with_epochs(df: DataFrame, n_epochs: int, epoch_col: str = "epoch") -> DataFrame:
    """U4 (finite re-aim of 'repeat forever'): each row once per epoch, with
    an ``epoch`` column — a generator, not a join."""
    return df.withColumn(epoch_col, F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))


def epoch_positions(df: DataFrame, key: str, n_epochs: int, seed: int = 42, epoch_col: str = "epoch",
                    out: str = "position") -> DataFrame:
    """L6 + U4: each row once per epoch with its place in that epoch's order.
    Rows are ranked once, by ``key``; an epoch's order is a permutation of the
    ranks that is keyed by (seed, epoch), so no epoch is sorted."""
    n = df.count()
    ranked = global_rank(df, F.col(key), F.col(key), out="_rank").withColumn("_size", domain(F.lit(n)))
    ranked = with_epochs(ranked, n_epochs, epoch_col).withColumn("_keys", round_keys(seed, F.col(epoch_col)))
    return ranked.withColumn(out, permuted(F.col("_rank"), F.col("_size"), F.col("_keys"))).drop("_rank", "_size", "_keys")


# ------------------------------------------------------------ global rank

#: A bucket of more rows than this is cut again before rows are numbered.
HEAVY = 10_000


def global_rank(df: DataFrame, value: Column, tiebreak: Column, out: str = "rank",
                buckets: int = BUCKETS, heavy: int = HEAVY) -> DataFrame:
    """Exact 0-based position of every row in (value, tiebreak) order,
    without a single-partition window.

    Value ranges are counted in at most ``buckets`` buckets a pass.  A bucket
    of more than ``heavy`` rows (and eight times the mean) becomes a range of
    its own in the next pass, so an outlier or a dense region does not end in
    one task; rows with one same value are cut by their tiebreak.  Each pass
    broadcasts a table bounded by ``buckets``; the window numbers the rows of
    one final bucket.  ``value`` must be integral; null values come last.

    The passes read values and tiebreaks that are written once, so what ``df``
    computes (tokens, say) is not computed again for each of them.
    """
    kind = df.select(tiebreak.alias("t")).schema["t"].dataType.typeName()
    order = tiebreak.cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(tiebreak)
    exact = kind in ("byte", "short", "integer", "long")
    first = F.when(F.col("_v").isNull(), 1).otherwise(0).cast("long")  # null values: a range of their own behind all others
    v = df.withColumn("_v", value.cast("long")).withColumn("_t", tiebreak).withColumn("_g", first).withColumn("_o", order)
    keys, kept = v.select("_v", "_g", "_o"), scratch_path(df.sparkSession, "rank")
    keys.write.parquet(kept)
    keys = df.sparkSession.read.schema(keys.schema).parquet(kept)
    lo, hi, total = keys.agg(F.min("_v"), F.max("_v"), F.count(F.lit(1))).first()
    if not total:
        return v.withColumn(out, F.lit(None).cast("long")).drop("_v", "_t", "_g", "_o")
    lo, hi = (0, 0) if lo is None else (lo, hi)
    open_groups = {0: (lo, hi, "_v"), 1: None}
    limit = max(heavy, 8 * total // buckets)
    spark, ids = df.sparkSession, 2
    # order of groups: a path of bucket numbers
    path = {0: (0,), 1: (1,)}
    counts = {r["_g"]: r["count"] for r in keys.groupBy("_g").count().collect()}
    final = {}
    if counts.get(1, 0) > limit and exact:
        a, b = keys.where("_g = 1").agg(F.min("_o"), F.max("_o")).first()
        open_groups[1] = (a, b, "_o") if a is not None and a < b else None
    for g in (0, 1):
        if g in counts and (open_groups[g] is None or counts[g] <= limit):
            final[g] = counts[g]
            open_groups[g] = None
    live = {g: r for g, r in open_groups.items() if r is not None and g in counts}
    while live:
        share, width = max(2, buckets // len(live)), {}
        for g, (a, b, _) in live.items():  # upper bits: no difference can overflow
            width[g] = next(s for s in range(64) if (b >> s) - (a >> s) < share)
        table = [(g, width[g], c == "_v") for g, (a, b, c) in live.items()]
        at = spark.createDataFrame(table, "_g long, _w int, _byv boolean")
        v, keys = (d.join(F.broadcast(at), "_g", "left")
                   .withColumn("_b", F.expr("CASE WHEN _w IS NOT NULL THEN shiftright(CASE WHEN _byv THEN _v ELSE _o END, _w) END"))
                   for d in (v, keys))
        hist = (keys.where("_b is not null").groupBy("_g", "_b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("o1"), F.max("_o").alias("o2")).collect())
        moves, nxt = [], {}
        for r in hist:
            g, b, n = r["_g"], r["_b"], r["n"]
            a, _, col = live[g]
            path[ids] = (*path[g], b)
            moves.append((g, b, ids))
            if n <= limit:
                final[ids] = n
            elif width[g] > 0:
                nxt[ids] = (max(a, b << width[g]), min(live[g][1], ((b + 1) << width[g]) - 1), col)
            elif col == "_v" and exact and r["o1"] is not None and r["o1"] < r["o2"]:
                nxt[ids] = (r["o1"], r["o2"], "_o")
            else:
                final[ids] = n
            ids += 1
        move = spark.createDataFrame(moves, "_g long, _b long, _to long")
        v, keys = (d.join(F.broadcast(move), ["_g", "_b"], "left").withColumn("_g", F.coalesce("_to", "_g"))
                   .drop("_w", "_byv", "_b", "_to") for d in (v, keys))
        live = nxt
    rows, before = [], 0
    for g in sorted(final, key=path.__getitem__):
        rows.append((g, before))
        before += final[g]
    off = spark.createDataFrame(rows, "_g long, _off long")
    w = Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_last(), "_t")
    return (v.join(F.broadcast(off), "_g")
            .withColumn(out, F.col("_off") + F.row_number().over(w) - 1)
            .drop("_v", "_t", "_g", "_o", "_off"))
