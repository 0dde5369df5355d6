"""Noise schedules as Column functions (N2, N3, N4) with name registries.

α schedules: linear ``1 - t``; cosine ``1 - cos(π/2 · (1 - t))``.
κ schedules: cubic ``(a+1)t³ - (a+b+1)t² + (b+1)t`` (linear: a=-1, b=0);
cosine ``1 - cos(π/2 · t)``.  Loss weights ``-α'/(1-α+1e-6)`` and
``κ'/(1-κ+1e-6)``.  Domain [0, 1]; values outside raise at run time.
Names are case-insensitive; unknown names list the available ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI = math.pi / 2


def _checked(t: Column) -> Column:
    ok = (t >= 0.0) & (t <= 1.0)
    return F.when(ok, t).otherwise(F.raise_error(F.concat(F.lit("t not in [0,1]: "), t.cast("string"))))


class Schedule:
    def __init__(self, value, derivative):
        self._v, self._d = value, derivative

    def value(self, t: Column) -> Column:
        return self._v(_checked(t))

    def derivative(self, t: Column) -> Column:
        return self._d(_checked(t))


ALPHA = {
    "linear": Schedule(lambda t: 1.0 - t, lambda t: F.lit(-1.0) + t * 0.0),
    "cosine": Schedule(lambda t: 1.0 - F.cos(HALF_PI * (1.0 - t)),
                       lambda t: -HALF_PI * F.sin(HALF_PI * (1.0 - t))),
}


def cubic_kappa(a: float = 1.0, b: float = 1.0) -> Schedule:
    return Schedule(lambda t: (a + 1) * F.pow(t, 3) - (a + b + 1) * F.pow(t, 2) + (b + 1) * t,
                    lambda t: 3 * (a + 1) * F.pow(t, 2) - 2 * (a + b + 1) * t + (b + 1))


KAPPA = {
    "cubic": cubic_kappa(1.0, 1.0),
    "linear": cubic_kappa(-1.0, 0.0),
    "cosine": Schedule(lambda t: 1.0 - F.cos(HALF_PI * t), lambda t: HALF_PI * F.sin(HALF_PI * t)),
}


def _get(reg: dict, name: str) -> Schedule:
    key = name.lower().replace("alphascheduler", "").replace("kappascheduler", "")
    if key not in reg:
        raise ValueError(f"there is no schedule {name!r}, only {sorted(reg)}")
    return reg[key]


def alpha(t: Column, kind: str = "linear") -> Column:
    return _get(ALPHA, kind).value(t)


def alpha_derivative(t: Column, kind: str = "linear") -> Column:
    return _get(ALPHA, kind).derivative(t)


def kappa(t: Column, kind: str = "cubic") -> Column:
    return _get(KAPPA, kind).value(t)


def kappa_derivative(t: Column, kind: str = "cubic") -> Column:
    return _get(KAPPA, kind).derivative(t)


def loss_weight(t: Column, kind: str = "linear", family: str = "alpha") -> Column:
    """α weight ``-α'/(1-α+1e-6)``, κ weight ``κ'/(1-κ+1e-6)``, or
    ``uniform`` = 1."""
    if family == "uniform" or kind == "uniform":
        return F.lit(1.0)
    if family == "alpha":
        return -alpha_derivative(t, kind) / (1.0 - alpha(t, kind) + 1e-6)
    return kappa_derivative(t, kind) / (1.0 - kappa(t, kind) + 1e-6)


def alpha_f32(i: Column, kind: str = "linear") -> Column:
    """α evaluated in float32 (the reference casts its inputs to float32)."""
    one = F.lit(1.0).cast("float")
    i = i.cast("float")
    if kind == "linear":
        return (one - i).cast("float")
    if kind == "cosine":
        return (one - F.cos(F.lit(HALF_PI).cast("float") * (one - i).cast("float")).cast("float")).cast("float")
    raise ValueError(f"no single-precision schedule {kind!r}, only cosine and linear")


def reverse_transfer(s: Column, t: Column, kind: str = "linear") -> Column:
    """``1 - (1-α(s))/(1-α(t))`` with float32 operands and quotient,
    returned as double (as the reference's ``.item()`` then ``1 - x``)."""
    one = F.lit(1.0).cast("float")
    num = (one - alpha_f32(s, kind)).cast("float")
    den = (one - alpha_f32(t, kind)).cast("float")
    return F.lit(1.0) - (num / den).cast("float").cast("double")


def sql_alpha_f32(i: str, kind: str) -> str:
    if kind == "linear":
        return f"(1::FLOAT - ({i})::FLOAT)::FLOAT"
    return (f"(1::FLOAT - cos(({HALF_PI})::FLOAT * (1::FLOAT - ({i})::FLOAT)::FLOAT)::FLOAT)::FLOAT")


def sql_reverse_transfer(s: str, t: str, kind: str) -> str:
    num = f"(1::FLOAT - {sql_alpha_f32(s, kind)})::FLOAT"
    den = f"(1::FLOAT - {sql_alpha_f32(t, kind)})::FLOAT"
    return f"(1.0::DOUBLE - (({num}) / ({den}))::FLOAT::DOUBLE)"
