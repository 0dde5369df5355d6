"""Exact "first n rows" of many groups in shared passes.

A global ``row_number`` plans to ``Exchange SinglePartition`` and a large
``orderBy().limit(n)`` funnels n rows through one task.  Here the n-th smallest
value is found instead, and the selection is a plain filter, so that rows never
leave their partitions.  All groups (sources, splits) and all ranks of a
``Cuts`` are refined together: one aggregation for the bounds of every group,
then histograms of at most ``BUCKETS`` rows in all, each over the ranges that
still hold a cut.  Keys in a range of 65,536 need one histogram, any 64-bit
keys at most four.

Buckets are the upper bits of a value: an arithmetic shift never overflows,
whatever the sign and the range.  Equal values at a cut are resolved by the
tiebreaks, one after another, in the same way; rows that no tiebreak tells
apart raise.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
_LAST = (1 << 63) - 1
_INTEGRAL = ("byte", "short", "integer", "long")


@dataclass(frozen=True)
class Cut:
    """Rows with ``value < value_cut``, and those with that value and the
    tiebreaks up to ``ties``, are the first ``n`` rows."""

    n: int
    value_cut: int | None       # None: no row selected
    ties: tuple[int, ...] = ()
    everything: bool = False    # n >= row count
    nulls: bool = False         # every value, and null values up to the ties

    def predicate(self, value: Column, *ties: Column) -> Column:
        if self.everything:
            return F.lit(True)
        if self.value_cut is None and not self.nulls:
            return F.lit(False)
        last = F.lit(True)
        for c, at in reversed(list(zip(ties, self.ties))):
            last = (c < F.lit(at)) | ((c == F.lit(at)) & last)
        if self.nulls:
            return value.isNotNull() | last
        v = F.lit(self.value_cut)
        return F.coalesce((value < v) | ((value == v) & last), F.lit(False))


def tie(df: DataFrame, c: Column | str) -> Column:
    """A tiebreak as a number that is never null: the value of an integral
    column (null last), the hash of another."""
    c = F.col(c) if isinstance(c, str) else c
    if df.select(c.alias("c")).schema["c"].dataType.typeName() in _INTEGRAL:
        return F.coalesce(c.cast("long"), F.lit(_LAST))
    return F.xxhash64(c)


def row_hash(df: DataFrame) -> Column:
    """A number by which different rows can be told apart."""
    return F.xxhash64(*(F.to_json(F.col(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema))


@dataclass
class Part:
    """Rows with an integral order ``value``, tiebreaks and a group."""

    df: DataFrame
    value: Column
    ties: Sequence[Column | str] = ()
    group: Column | None = None

    def __post_init__(self):
        self.value = self.value.cast("long")
        self.group = F.lit("") if self.group is None else self.group.cast("string")
        self.ties = tuple(tie(self.df, c) for c in self.ties)

    def within(self, cut: Cut) -> Column:
        return cut.predicate(self.value, *self.ties)


def _bounds(rows: DataFrame) -> dict[tuple[str, str], tuple]:
    """(least, greatest, values, rows) of each ``_s, _g``."""
    found = rows.groupBy("_s", "_g").agg(F.min("_v"), F.max("_v"), F.count("_v"), F.count(F.lit(1))).collect()
    return {(r[0], r[1]): tuple(r)[2:] for r in found}


def _search(rows: DataFrame, live: dict[tuple[str, str, int], tuple[int, int]]) -> dict[tuple[str, str, int], tuple[int, int, int]]:
    """For each (part, group, n) with its bounds: the n-th smallest value,
    its place among equal values, and how many of these there are."""
    todo, done = {k: (lo, hi, k[2]) for k, (lo, hi) in live.items()}, {}
    spark = rows.sparkSession
    while todo:
        ranges = sorted({(s, g, lo, hi) for (s, g, _), (lo, hi, _) in todo.items()})
        share, table = max(2, BUCKETS // len(ranges)), []
        for number, (s, g, lo, hi) in enumerate(ranges):
            shift = 0
            while (hi >> shift) - (lo >> shift) >= share:
                shift += 1
            table.append((s, g, lo, hi, number, shift))
        at = spark.createDataFrame(table, "_s string, _g string, _lo long, _hi long, _r int, _shift int")
        hist = (rows.join(F.broadcast(at), ["_s", "_g"]).where("_v between _lo and _hi")
                .groupBy("_r", F.expr("shiftright(_v, _shift)").alias("b")).count().collect())
        counts: dict[int, list] = {}
        for r in hist:
            counts.setdefault(r["_r"], []).append((r["b"], r["count"]))
        shifts = {t[:4]: (t[4], t[5]) for t in table}
        for key, (lo, hi, need) in list(todo.items()):
            number, shift = shifts[key[0], key[1], lo, hi]
            for bucket, n in sorted(counts[number]):
                if need <= n:
                    break
                need -= n
            if shift == 0:
                done[key] = (bucket, need, n)
                del todo[key]
            else:
                todo[key] = (max(lo, bucket << shift), min(hi, ((bucket + 1) << shift) - 1), need)
    return done


class Cuts:
    """Cuts of several parts.  ``groups`` holds the rows of each (part, group)
    after one aggregation; rows of a null group belong to none."""

    def __init__(self, parts: Mapping[str, Part]):
        self.parts = dict(parts)
        self.rows = self._union((p.df, F.lit(name), p.group, p.value) for name, p in self.parts.items())
        self.bounds = _bounds(self.rows) if self.parts else {}
        self.groups = {k: b[3] for k, b in self.bounds.items()}

    @staticmethod
    def _union(rows) -> DataFrame | None:
        frames = [df.select(s.alias("_s"), g.alias("_g"), v.alias("_v")).where("_g is not null") for df, s, g, v in rows]
        return reduce(DataFrame.union, frames) if frames else None

    def find(self, wants: Mapping[tuple[str, str], Sequence[int | float]]) -> dict[tuple[str, str, int | float], Cut]:
        """The cut of each (part, group) and want: a row count, or a share of
        the group's rows (rounded up)."""
        out, live, open_ = {}, {}, {}
        for (s, g), each in wants.items():
            lo, hi, values, total = self.bounds.get((s, g), (None, None, 0, 0))
            for want in each:
                n = math.ceil(want * total) if isinstance(want, float) else int(want)
                if n <= 0 or total == 0 or n >= total:
                    out[s, g, want] = Cut(n, None, everything=0 < total <= n)
                elif n > values:
                    open_[s, g, want] = (n, None, (), n - values)
                else:
                    live[s, g, n] = (lo, hi)
                    open_[s, g, want] = (n, n, (), 0)
        found = _search(self.rows, live) if live else {}
        pending = {}
        for key, (n, at, _, rest) in open_.items():
            if at is None:
                pending[key] = (n, None, (), rest)
                continue
            value, rest, same = found[key[0], key[1], n]
            if rest == same:
                out[key] = Cut(n, value)
            else:
                pending[key] = (n, value, (), rest)
        depth = 0
        while pending:
            pending = self._next_tie(pending, depth, out)
            depth += 1
        return out

    def _next_tie(self, pending: dict, depth: int, out: dict) -> dict:
        """Cuts of rows that are equal so far, by the tiebreak ``depth``."""
        names = {key: f"{number}" for number, key in enumerate(pending)}
        rows = []
        for s, part in self.parts.items():
            own = [(key, x) for key, x in pending.items() if key[0] == s]
            if own and depth >= len(part.ties):
                raise ValueError(f"rows of {own[0][0]} are equal in value and every tiebreak; a cut between them needs another")
            for key, (_, value, ties, _) in own:
                same = (part.group == F.lit(key[1])) & part.value.eqNullSafe(F.lit(value))
                for c, at in zip(part.ties, ties):
                    same = same & (c == F.lit(at))
                rows.append((part.df.where(same), F.lit(s), F.lit(names[key]), part.ties[depth]))
        tied = self._union(rows)
        bounds = _bounds(tied)
        live = {(key[0], names[key], rest): bounds[key[0], names[key]][:2] for key, (*_, rest) in pending.items()}
        found, left = _search(tied, live), {}
        for key, (n, value, ties, rest) in pending.items():
            at, rest, same = found[key[0], names[key], rest]
            if rest == same:
                out[key] = Cut(n, value, (*ties, at), nulls=value is None)
            else:
                left[key] = (n, value, (*ties, at), rest)
        return left


def rank_cut(df: DataFrame, value: Column, *ties: Column | str, n: int | None = None, frac: float | None = None) -> tuple[Part, Cut]:
    """The cut for the first ``n`` rows (or a share of them) by an integral
    value, null last, and the part whose ``within`` applies it."""
    part = Part(df, value, ties)
    want = n if frac is None else float(frac)
    return part, Cuts({"": part}).find({("", ""): [want]})["", "", want]
