"""DuckDB spellings of the library's expressions, written apart from the Spark ones that they check."""

from __future__ import annotations

import math

import numpy as np

COLUMNS = ("px", "py", "pz", "x", "y")
FAULTS = {
    "px": "CASE WHEN l_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity - 25.5e0 END",
    "pz": "CASE WHEN l_orderkey % 83 = 0 THEN -1e0 ELSE l_extendedprice / 1000e0 END",
    "x": "CASE WHEN l_orderkey % 79 = 0 THEN 2000e0 ELSE l_tax * 100e0 - 4e0 END",
    "id": "CASE WHEN l_orderkey % 73 = 0 THEN 13.5e0 WHEN l_orderkey % 67 = 0 THEN 11e0 WHEN l_returnflag = 'R' THEN 13e0 ELSE -13e0 END",
    "w": "CASE WHEN l_orderkey % 71 = 0 THEN 0e0 WHEN l_linestatus = 'F' THEN 7.6875e0 ELSE 768.75e0 END",
    "py": "(l_discount - 0.05e0) * 100e0",
    "y": "l_linenumber - 4.0e0",
    "z": "28.905e0",
}
#: State rows with planted faults, by order key.
FAULTY = ", ".join(f"{FAULTS[c]} AS {c}" for c in ("px", "py", "pz", "x", "y", "z", "id", "w"))
FAULTY_SQL = f"(SELECT {FAULTY}, l_linestatus AS side FROM lineitem)"


def ok(c: str) -> str:
    return f"coalesce(isfinite({c}), false)"


def code(*parts: object) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(map(str, parts)) + ")), 1, 12))::BIGINT"


def uniform(*parts: object) -> str:
    return f"(({code(*parts)} + 0.5e0) / 281474976710656e0)"


def normal(key: str, seed: int, k: int) -> str:
    return f"(sqrt(-2e0 * ln({uniform(key, seed, 2 * k)})) * cos({2 * math.pi!r} * {uniform(key, seed, 2 * k + 1)}))"


def gauss(columns, mean, cov) -> str:
    """Log density through the inverse matrix rather than a substitution."""
    cov = np.asarray(cov, float)
    inv, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    const = float(-0.5 * (len(mean) * math.log(2 * math.pi) + logdet))
    return f"({const!r} - 0.5 * {quadratic(columns, mean, inv)})"


def quadratic(columns, mean, inv) -> str:
    d = [f"({c} - ({m!r}))" for c, m in zip(columns, mean, strict=True)]
    terms = [f"({float(inv[i][j])!r}) * {d[i]} * {d[j]}" for i in range(len(d)) for j in range(len(d)) if abs(inv[i][j]) > 1e-15]
    return "(" + " + ".join(terms) + ")"


def lse(terms: list[str]) -> str:
    if len(terms) == 1:
        return terms[0]
    top = "greatest(" + ", ".join(terms) + ")"
    return f"({top} + ln(" + " + ".join(f"exp({t} - {top})" for t in terms) + "))"
