"""Deterministic uniform draws.

Every random choice in the library goes through ``uniform(seed, *keys)``:
the first 52 bits of ``md5('seed:key1:key2…')`` divided by 2^52.  It depends
only on the keys, never on partitioning or task order, so a lost executor
re-computes the very same draws, and DuckDB can compute the identical value
for the correctness oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _key(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    if isinstance(k, str):
        return F.col(k).cast("string")
    return F.lit(str(k))


def seed_key(seed, *keys) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[_key(k) for k in keys])


def hash52(seed, *keys) -> Column:
    """52-bit non-negative integer hash of (seed, keys)."""
    return F.conv(F.substring(F.md5(seed_key(seed, *keys)), 1, 13), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """U(seed, keys) in [0, 1), bit-identical to the DuckDB oracle helper."""
    return hash52(seed, *keys).cast("double") / F.lit(TWO_52)


def stem(seed, *keys) -> Column:
    """What the draws ``uniform(seed, *keys, i)`` of a row have in common, to be
    worked out once a row; see ``drawn_below``."""
    return F.concat(seed_key(seed, *keys), F.lit(":"))


def drawn(stem: Column, i: Column) -> Column:
    """``uniform(seed, *keys, i)`` of the row's ``stem``."""
    return F.conv(F.substring(F.md5(F.concat(stem, i.cast("string"))), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)


def edge(p: Column) -> Column:
    """``p`` as hex digits: a draw is below ``p`` where its digest is below
    these.  Scaling by 2^52 is exact, so both comparisons agree."""
    digits = F.lpad(F.lower(F.hex(F.ceil(p * F.lit(TWO_52)))), 13, "0")
    return F.when(p * F.lit(TWO_52) > F.lit(TWO_52 - 1), F.lit("g")).when(p > 0, digits).when(p <= 0, F.lit(""))


def drawn_below(stem: Column, i: Column, edge: Column) -> Column:
    """``uniform(seed, *keys, i) < p``, without making a number of each draw."""
    return F.md5(F.concat(stem, i.cast("string"))) < edge


def once(values: dict[str, Column], body) -> Column:
    """``body`` over a struct of ``values`` that are worked out once a row.  A
    lambda is evaluated for each element with all that it holds, and Spark may
    move a column's expression into it, so what does not depend on the element
    is bound outside."""
    row = F.array(F.struct(*(c.alias(name) for name, c in values.items())))
    return F.get(F.transform(row, body), 0)


def uniform_int(seed, lo: Column | int, hi: Column | int, *keys) -> Column:
    """Integer uniformly drawn from [lo, hi] inclusive."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(uniform(seed, *keys) * (hi_c - lo_c + 1))).cast("bigint")


# ---- DuckDB counterparts used by the oracle SQL --------------------------

def sql_seed_key(seed, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"concat_ws(':', {parts})"


def sql_hash52(seed, *keys: str) -> str:
    return f"(('0x' || substr(md5({sql_seed_key(seed, *keys)}), 1, 13))::BIGINT)"


def sql_uniform(seed, *keys: str) -> str:
    return f"({sql_hash52(seed, *keys)}::DOUBLE / 4503599627370496.0)"


def sql_uniform_int(seed, lo: str, hi: str, *keys: str) -> str:
    return f"(({lo}) + floor({sql_uniform(seed, *keys)} * (({hi}) - ({lo}) + 1)))::BIGINT"
