"""Column expressions: kernels, distances, robustness weights, Hermite blending, diagnostics, intervals.

All of these stay in the JVM and take part in code generation. Arguments are columns or column names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def span(n: Column | str, fraction: float) -> Column:
    """Points of a neighbourhood of a series with ``n`` rows."""
    n = _c(n)
    return F.greatest(F.lit(2).cast("long"), F.least(n.cast("long"), F.floor(n * F.lit(float(fraction)) + F.lit(1e-5)).cast("long")))


def kernel(name: str, u: Column | str) -> Column:
    """Weight at scaled distance ``u``."""
    u = F.abs(_c(u))
    if name == "gaussian":
        return F.when(u > 6, F.lit(TINY)).otherwise(F.greatest(F.exp(-(u * u) / 2), F.lit(TINY)))
    inside = {
        "cosine": lambda: F.cos(F.lit(math.pi / 2) * u),
        "epanechnikov": lambda: 1 - u * u,
        "biweight": lambda: (1 - u * u) * (1 - u * u),
        "triangle": lambda: 1 - u,
        "tricube": lambda: (1 - u * u * u) * (1 - u * u * u) * (1 - u * u * u),
        "uniform": lambda: F.lit(1.0),
    }[name]()
    return F.when(u < 1, inside).otherwise(F.lit(0.0))


#: Integral, variance and roughness of each kernel.
KERNEL_PROPERTIES = {
    "cosine": (4 / math.pi, 4 / math.pi - 32 / math.pi**3, 1.0),
    "epanechnikov": (4 / 3, 4 / 15, 16 / 15),
    "gaussian": (math.sqrt(2 * math.pi), math.sqrt(2 * math.pi), math.sqrt(math.pi)),
    "biweight": (16 / 15, 16 / 105, 256 / 315),
    "triangle": (1.0, 1 / 6, 2 / 3),
    "tricube": (81 / 70, 1 / 6, 6561 / 6916),
    "uniform": (2.0, 2 / 3, 2.0),
}


def efficiency(name: str) -> float:
    """Efficiency relative to the Epanechnikov kernel."""
    c, mu, r = KERNEL_PROPERTIES[name]
    ce, mue, re = KERNEL_PROPERTIES["epanechnikov"]
    return (re / r) ** 0.8 * (mue / mu) ** 0.4 * (c / ce) ** 2


def kernel_properties(spark: SparkSession) -> DataFrame:
    """One row per kernel: integral, variance, roughness, efficiency and whether it is bounded."""
    rows = [(k, *v, efficiency(k), k != "gaussian") for k, v in KERNEL_PROPERTIES.items()]
    return spark.createDataFrame(rows, "kernel string, integrator double, variance double, roughness double, efficiency double, bounded boolean")


def distance(name: str, a: list, b: list, scales: list | None = None, p: float = 2.0, weights: list[float] | None = None) -> Column:
    """Distance of two points given as lists of columns."""
    gaps = [F.abs(_c(x) - _c(y)) for x, y in zip(a, b, strict=True)]
    if name == "minkowski" and p == 1:
        name = "manhattan"
    if name == "minkowski" and p == 2:
        name = "euclidean"
    if name == "normalized":
        gaps = [g * _c(s) for g, s in zip(gaps, scales, strict=True)]
    if name == "chebyshev":
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    if name == "manhattan":
        parts = gaps
    elif name == "minkowski":
        parts = [F.pow(g, F.lit(float(p))) for g in gaps]
    elif name == "weighted":
        parts = [g * g * F.lit(float(w)) for g, w in zip(gaps, weights, strict=True)]
    else:
        parts = [g * g for g in gaps]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return total if name == "manhattan" else F.pow(total, F.lit(1.0 / p)) if name == "minkowski" else F.sqrt(total)


def array_distance(name: str, a: Column | str, b: Column | str, p: float = 2.0, weights: Column | None = None) -> Column:
    """Distance of two points given as arrays of doubles."""
    gaps = F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if name == "chebyshev":
        return F.array_max(gaps)
    add = lambda f: F.aggregate(gaps, F.lit(0.0), lambda t, g: t + f(g))
    if name == "manhattan":
        return add(lambda g: g)
    if name == "minkowski":
        return F.pow(add(lambda g: F.pow(g, F.lit(float(p)))), F.lit(1.0 / p))
    if name == "weighted":
        return F.sqrt(F.aggregate(F.zip_with(gaps, weights, lambda g, w: g * g * w), F.lit(0.0), lambda t, g: t + g))
    return F.sqrt(add(lambda g: g * g))


def robustness_weight(name: str, residual: Column | str, scale: Column | str) -> Column:
    """Weight of a row from its residual and the scale of all residuals."""
    r, s = F.abs(_c(residual)), _c(scale)
    if name == "bisquare":
        u = r / F.greatest(6 * s, F.lit(1e-12))
        w = F.when(u <= 0.001, 1.0).when(u >= 0.999, 0.0).otherwise((1 - u * u) * (1 - u * u))
    elif name == "huber":
        w = F.when(r <= 1.345 * s, 1.0).otherwise(1.345 / (r / s))
    else:
        w = F.when(r <= 2.5 * s, 1.0).otherwise(0.0)
    return F.when(s <= 0, F.lit(1.0)).otherwise(w)


def guarded_scale(scale: Column | str, mean_abs: Column | str) -> Column:
    """A robust scale with its floor against vanishing medians."""
    s, m = _c(scale), _c(mean_abs)
    return F.when(m == 0, F.lit(0.0)).when(s <= F.greatest(1e-7 * m, F.lit(1e-12)), F.greatest(m, s)).otherwise(s)


def hermite(x: Column | str, low, high, v0, v1, g0, g1) -> Column:
    """Cubic Hermite blend of the values and slopes at both ends of a cell."""
    x, low, high = _c(x), _c(low), _c(high)
    width = high - low
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.when(width > 2.220446049250313e-16, width).otherwise(1.0)))
    value = (1 - h) * (1 - h) * (1 + 2 * h) * _c(v0) + h * h * (3 - 2 * h) * _c(v1) + (h * (1 - h) * (1 - h) * _c(g0) + h * h * (h - 1) * _c(g1)) * width
    return F.when(width > 2.220446049250313e-16, value).otherwise(_c(v0))


def linear_at_zero(s0, s1, s2, t0, t1) -> Column:
    """Intercept of a weighted line from its moments sum w d^k and sum w d^k y; the weighted mean if it is singular."""
    s0, s1, s2, t0, t1 = map(_c, (s0, s1, s2, t0, t1))
    det = s0 * s2 - s1 * s1
    return F.when(F.abs(det) > 1e-12 * s0 * s2, (s2 * t0 - s1 * t1) / det).otherwise(t0 / s0)


def linear_leverage(s0, s1, s2) -> Column:
    """First diagonal element of the inverse normal matrix of a weighted line."""
    s0, s1, s2 = map(_c, (s0, s1, s2))
    det = s0 * s2 - s1 * s1
    return F.when(F.abs(det) > 1e-12 * s0 * s2, s2 / det).otherwise(1 / s0)


def r_squared(rss: Column | str, tss: Column | str, n: Column | str) -> Column:
    rss, tss, n = _c(rss), _c(tss), _c(n)
    return F.when(n == 1, 1.0).when(tss == 0, F.when(rss == 0, 1.0).otherwise(0.0)).otherwise(1 - rss / tss)


def aic(rss: Column | str, n: Column | str, df: Column | str) -> Column:
    rss, n, df = _c(rss), _c(n), _c(df)
    return F.when(rss <= 0, F.lit(float("inf"))).otherwise(n * F.log(rss / n) + 2 * df)


def aicc(rss: Column | str, n: Column | str, df: Column | str) -> Column:
    n, df = _c(n), _c(df)
    return F.when(n - df - 1 > 0, aic(rss, n, df) + 2 * df * (df + 1) / (n - df - 1)).otherwise(F.lit(float("inf")))
