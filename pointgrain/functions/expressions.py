"""Column expressions used across the library. All are stateless, so they also run on streams."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.abs(c) < F.lit(INFINITY), F.lit(False))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def logcosh(x: Column) -> Column:
    """ln(cosh x) without overflow."""
    return F.abs(x) + F.log1p(F.exp(-2 * F.abs(x))) - math.log(2)


def logsumexp(terms: Sequence[Column]) -> Column:
    """ln of the sum of exp(terms); -inf, never NaN, when all terms are -inf."""
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return F.when(top == F.lit(-INFINITY), F.lit(-INFINITY)).otherwise(top + F.log(total([F.exp(t - top) for t in terms])))


def place(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts (an array column of at most 1,023) are at most value: a binary search."""
    steps = F.lit([1 << i for i in reversed(range(10))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def hash_code(*parts: Column) -> Column:
    """48 bits of the MD5 of the parts joined by bars: the same value in any engine and under any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("long")


def hash_uniform(*parts: Column) -> Column:
    """A number in the open unit interval."""
    return (hash_code(*parts) + 0.5) / float(1 << 48)


def hash_normal(key: Column, seed: int, k: int) -> Column:
    """The k-th standard normal of a key: Box-Muller on two hashed uniforms."""
    u, v = hash_uniform(key, F.lit(seed), F.lit(2 * k)), hash_uniform(key, F.lit(seed), F.lit(2 * k + 1))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


# Feature views of the physical state px, py, pz, x, y.

VIEWS = {"identity": ("px", "py", "pz", "x", "y"), "logpz": ("px", "py", "log_pz", "x", "y"), "slope": ("tx", "ty", "log_pz", "x", "y")}
#: How often ln(pz) enters the forward log-Jacobian, with a minus.
VIEW_POWER = {"identity": 0, "logpz": 1, "slope": 3}


def view_forward(view: str, unit: float = 1.0) -> dict[str, Column]:
    """Feature columns of a view; null where pz is not positive and the view needs its logarithm."""
    px, py, pz = F.col("px"), F.col("py"), F.col("pz")
    ok = pz > 0
    first = {"identity": (px, py), "logpz": (px, py), "slope": (F.when(ok, px / pz), F.when(ok, py / pz))}[view]
    third = pz if view == "identity" else F.when(ok, F.log(pz / unit))
    return dict(zip(VIEWS[view], (*first, third, F.col("x"), F.col("y")), strict=True))


def view_inverse(view: str, features: Mapping[str, Column], unit: float = 1.0) -> dict[str, Column]:
    """Physical columns from feature columns."""
    a, b, c, x, y = (features[n] for n in VIEWS[view])
    pz = c if view == "identity" else unit * F.exp(c)
    px, py = (a * pz, b * pz) if view == "slope" else (a, b)
    return {"px": px, "py": py, "pz": pz, "x": x, "y": y}


def view_log_jacobian(view: str, pz: Column) -> Column:
    """Forward log-Jacobian; the inverse one has the other sign. Null where pz is not positive."""
    k = VIEW_POWER[view]
    return F.lit(0.0) if k == 0 else F.when(pz > 0, -F.lit(float(k)) * F.log(pz))


# Exact transforms of the physical state, on dicts of columns.

State = Mapping[str, Column]


def banana(p: Mapping[str, float], s: State, inverse: bool = False) -> dict[str, Column]:
    """Triangular bend of py and x by px; its log-Jacobian is 0."""
    sign = -1.0 if inverse else 1.0
    u = s["px"] / p["scale_px"]
    return {**s, "py": s["py"] + sign * p["curvature"] * p["scale_py"] * u * u, "x": s["x"] + sign * p["shear"] * p["scale_x"] * u}


def skew(scales: Sequence[float], skews: Sequence[float], s: State, inverse: bool = False) -> dict[str, Column]:
    """Sinh-arcsinh skew of each column whose skew is not 0."""
    sign = -1.0 if inverse else 1.0
    return {n: c if b == 0 else a * F.sinh(sign * b + F.asinh(c / a)) for (n, c), a, b in zip(s.items(), scales, skews, strict=True)}


def skew_log_jacobian(scales: Sequence[float], skews: Sequence[float], s: State, inverse: bool = False) -> Column:
    sign = -1.0 if inverse else 1.0
    terms = [logcosh(sign * b + F.asinh(c / a)) - 0.5 * F.log1p((c / a) * (c / a)) for c, a, b in zip(s.values(), scales, skews, strict=True) if b != 0]
    return total(terms) if terms else F.lit(0.0)


# Gaussian densities with their parameters factored once and inlined.

LOG_2PI = math.log(2 * math.pi)


def diag_gauss_logpdf(x: Sequence[Column], mean: Sequence[float], var: Sequence[float]) -> Column:
    const = -0.5 * (len(mean) * LOG_2PI + sum(map(math.log, var)))
    return F.lit(const) - 0.5 * total([(c - m) * (c - m) / v for c, m, v in zip(x, mean, var, strict=True)])


def full_gauss_logpdf(x: Sequence[Column], mean: Sequence[float], cov: Sequence[Sequence[float]]) -> Column:
    _, logdet = np.linalg.slogdet(np.asarray(cov, float))
    return F.lit(-0.5 * (len(mean) * LOG_2PI + float(logdet))) - 0.5 * mahalanobis_sq(x, mean, cov)


def mahalanobis_sq(x: Sequence[Column], mean: Sequence[float], cov: Sequence[Sequence[float]]) -> Column:
    """The quadratic form of the inverse matrix: a term for each pair of coordinates, and none inside another."""
    precision = np.linalg.inv(np.asarray(cov, float))
    d = [c - m for c, m in zip(x, mean, strict=True)]
    pairs = [(i, j, float(precision[i, j]) * (1 if i == j else 2)) for i in range(len(d)) for j in range(i, len(d))]
    return total([d[i] * d[j] * p for i, j, p in pairs if abs(p) > 1e-15])
