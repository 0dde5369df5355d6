"""Keyed permutations of [0, n): a place for every position, without a sort.

A domain a × b with a = ceil(sqrt n) and b = ceil(n / a) holds [0, n) with
fewer than a numbers to spare.  Four Feistel rounds turn (l, r) by adding a
keyed function of one half to the other, modulo its size, so each round is
one-to-one; a result that is not below n is sent through again (cycle walking),
which keeps [0, n) a permutation of itself.  The keys come from md5 of a seed
and columns, so a permutation depends on nothing else, and DuckDB computes the
same one.  It mixes well enough to shuffle; it hides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.rand import seed_key, sql_seed_key

#: Fixed value: the Mersenne prime below 2^31; products of two fit in 64 bits.
P = 2_147_483_647
ROUNDS = 4
#: Passes of a walk.  As the spare numbers are fewer than sqrt(n) + 1, most
#: numbers need one, and 64 in a row are out of reach (they would raise).
SHORT, LONG = 4, 64


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def round_keys(seed, *keys) -> Column:
    """Factors and addends of the rounds, from two md5 digests."""
    digests = F.concat(F.md5(seed_key(seed, F.lit("m"), *keys)), F.md5(seed_key(seed, F.lit("c"), *keys)))
    return F.array(*(F.conv(F.substring(digests, 1 + 8 * k, 8), 16, 10).cast("long") % P for k in range(2 * ROUNDS)))


def domain(n: Column) -> Column:
    """``n`` with the sides of the domain that holds [0, n)."""
    n = n.cast("long")
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    return F.struct(n.alias("n"), a.alias("a"), F.greatest(_div(n + a - 1, a), F.lit(1)).alias("b"))


def _mixed(y: Column, keys: Column, k: Column) -> Column:
    """The round function: a keyed square modulo ``P``."""
    g = (y % P * keys[k] + keys[k + ROUNDS]) % P
    return (g * g + y) % P


def _walk(x: Column, size: Column, keys: Column, passes: int) -> Column:
    """The place of ``x``, or null after ``passes``.  The state is the number
    that is sent through, or -1 - place once that is found."""
    n, a, b = size["n"], size["a"], size["b"]

    def turn(v, i):
        left, right, k = _div(v, b), v % b, i % ROUNDS
        return (F.when(v < 0, v)
                .when((k == 0) & (i > 0) & (v < n), -1 - v)
                .when(k % 2 == 0, (left + _mixed(right, keys, k)) % a * b + right)
                .otherwise(left * b + (right + _mixed(left, keys, k)) % b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * passes)), x.cast("long"), turn, lambda v: F.when(v < 0, -1 - v))


def permuted(x: Column, size: Column, keys: Column) -> Column:
    """The place of position ``x`` in [0, n) under ``keys``; ``size`` is the
    ``domain`` of n.  Both should be columns of the frame, not expressions, as
    they are looked at in every round."""
    lost = F.raise_error(F.lit("a walk of the permutation did not end")).cast("long")
    return F.coalesce(_walk(x, size, keys, SHORT), _walk(x, size, keys, LONG), lost)


# ---- DuckDB counterparts used by the oracle SQL --------------------------

def sql_round_keys(seed, *keys: str) -> str:
    digests = f"(md5({sql_seed_key(seed, chr(39) + 'm' + chr(39), *keys)}) || md5({sql_seed_key(seed, chr(39) + 'c' + chr(39), *keys)}))"
    return f"list_transform(range({2 * ROUNDS}), lambda i: ('0x' || substr({digests}, CAST(1 + 8 * i AS INT), 8))::BIGINT % {P})"


def sql_permuted(x: str, n: str, keys: str) -> str:
    """``keys`` names a column; ``x`` and ``n`` are columns or numbers."""
    a = f"greatest(CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT), 1)"
    b = f"greatest(({n} + {a} - 1) // {a}, 1)"

    def mixed(y):
        g = f"(({y} % {P} * {keys}[i % {ROUNDS} + 1] + {keys}[i % {ROUNDS} + {1 + ROUNDS}]) % {P})"
        return f"(({g} * {g} + {y}) % {P})"

    turn = (f"CASE WHEN v < 0 THEN v WHEN i % {ROUNDS} = 0 AND i > 0 AND v < {n} THEN -1 - v "
            f"WHEN i % 2 = 0 THEN (v // ({b}) + {mixed(f'(v % ({b}))')}) % ({a}) * ({b}) + v % ({b}) "
            f"ELSE v // ({b}) * ({b}) + (v % ({b}) + {mixed(f'(v // ({b}))')}) % ({b}) END")
    return f"(-1 - list_reduce(list_prepend(CAST({x} AS BIGINT), CAST(range({1 + ROUNDS * LONG}) AS BIGINT[])), lambda v, i: {turn}))"
