"""Scalar formulas. Those that the SQL of a query needs too are texts that both engines read."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc_sql(x: str) -> str:
    """Complementary error function of x >= 0, a rational approximation with an error below 1.5e-7."""
    t = f"(1.0e0 / (1.0e0 + 0.3275911e0 * ({x})))"
    # fixed values: coefficients of formula 7.1.26 in Abramowitz and Stegun, Handbook of Mathematical Functions
    return f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-({x}) * ({x})))"


def erfc(x: str) -> Column:
    return F.expr(f"if({x} < 0, 2.0e0 - {erfc_sql(f'-({x})')}, {erfc_sql(x)})")


def switch_sql(r: str, r_on: float, r_cut: float) -> str:
    x = f"((({r}) - {r_on!r}) / {r_cut - r_on!r})"
    return f"(CASE WHEN ({r}) <= {r_on!r} THEN 1.0e0 WHEN ({r}) >= {r_cut!r} THEN 0.0e0 ELSE 1.0e0 - 10.0e0 * {x} * {x} * {x} + 15.0e0 * {x} * {x} * {x} * {x} - 6.0e0 * {x} * {x} * {x} * {x} * {x} END)"


def switch_c2(r: str, r_on: float, r_cut: float) -> Column:
    """1 up to ``r_on``, 0 from ``r_cut``, between them 1 - 10x^3 + 15x^4 - 6x^5: twice differentiable."""
    return F.expr(switch_sql(r, r_on, r_cut))


def switch_c2_slope(r: Column, r_on: float, r_cut: float) -> Column:
    x = (r - r_on) / (r_cut - r_on)
    return F.when((r <= r_on) | (r >= r_cut), 0.0).otherwise((-30 * x * x + 60 * x * x * x - 30 * x * x * x * x) / (r_cut - r_on))


def bspline(u: Column, order: int) -> Column:
    """Cardinal B-spline of ``order`` 1 to 6, nonzero for 0 <= u < order: sum of truncated powers."""
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    if order == 1:
        return F.when((u >= 0) & (u < 1), 1.0).otherwise(0.0)
    total = F.lit(0.0)
    for k in range(order + 1):
        base = F.greatest(u - k, F.lit(0.0))
        total = total + F.lit((-1.0) ** k * math.comb(order, k)) * reduce(lambda x, _: x * base, range(order - 2), base)
    return F.when((u > 0) & (u < order), total / math.factorial(order - 1)).otherwise(0.0)


def bspline_slope(u: Column, order: int) -> Column:
    return bspline(u, order - 1) - bspline(u - 1, order - 1)


def huber(residual: Column, delta: float) -> Column:
    size = F.abs(residual)
    return F.when(size <= delta, 0.5 * residual * residual).otherwise(delta * (size - 0.5 * delta))


def weight_at(step: Column, kind: str, **p: float | Sequence[float]) -> Column:
    """Weight of a loss at a step.

    constant: value. linear, cosine: start, end, steps (held outside; cosine goes along half a period).
    piecewise: boundaries and one more values, the next value from each boundary on.
    """
    if kind == "constant":
        return F.lit(float(p["value"]))
    if kind in ("linear", "cosine"):
        if p["steps"] <= 0:
            raise ValueError("steps must be positive")
        part = F.least(F.greatest(step / float(p["steps"]), F.lit(0.0)), F.lit(1.0))
        part = part if kind == "linear" else 0.5 * (1 - F.cos(part * math.pi))
        return p["start"] + (p["end"] - p["start"]) * part
    if kind == "piecewise":
        bounds, values = list(p["boundaries"]), list(p["values"])
        if len(values) != len(bounds) + 1 or bounds != sorted(bounds):
            raise ValueError("piecewise needs ascending boundaries and one more value than boundaries")
        out = F.lit(float(values[0]))
        for b, v in zip(bounds, values[1:]):
            out = F.when(step >= b, float(v)).otherwise(out)
        return out
    raise ValueError(f"no such schedule: {kind}")
