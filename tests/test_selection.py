"""Exact quantiles against sorting, with ranges forced to be narrow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrain.operators import compare, profile, selection

LEVELS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def plain(values, level):
    there = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    at = level * (len(there) - 1)
    low, high = there[math.floor(at)], there[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize(("ordered", "parts"), [(200_000, 256), (40, 8), (3, 4)])
def test_quantiles_equal_those_of_a_sorted_column(spark, monkeypatch, ordered, parts):
    monkeypatch.setattr(selection, "ORDERED", ordered)
    monkeypatch.setattr(selection, "PARTS", parts)
    monkeypatch.setattr(selection, "ACCURACY", 50)
    rng = np.random.default_rng(2)
    n = 1500
    cells = {
        "distinct": rng.normal(size=n) * 10.0 ** rng.integers(-8, 9, n), "ties": rng.integers(0, 5, n).astype(float), "hot": np.where(np.arange(n) % 3 == 0, 7.0, rng.normal(size=n)),
        "one": np.full(n, -2.5), "ends": np.where(np.arange(n) % 50 == 0, np.inf, np.where(np.arange(n) % 50 == 1, -np.inf, rng.normal(size=n))),
    }
    rows = [tuple(float(c[i]) for c in cells.values()) + (None if i % 4 else float(i), None, i % 2) for i in range(n)]
    names = [*cells, "some", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", side int").repartition(5)
    got = {r[:3]: r[3] for r in selection.exact_quantiles(df, names, LEVELS, F.col("side"))}
    for s in (0, 1):
        mine = [r for r in rows if r[-1] == s]
        for k, c in enumerate(names):
            for level in LEVELS:
                if c == "none" or all(r[k] is None for r in mine):
                    assert got[s, c, level] is None
                else:
                    assert got[s, c, level] == plain([r[k] for r in mine], level), (s, c, level)
    whole = {(r["column"], r["level"]): r["value"] for r in profile.column_quantiles(df, ["distinct"], LEVELS).collect()}
    assert whole == {("distinct", q): plain(cells["distinct"].tolist(), q) for q in LEVELS}


def test_no_rows_and_nan_last(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    got = [r["value"] for r in profile.column_quantiles(df, ["v"], (0.0, 0.5, 1.0)).orderBy("level").collect()]
    assert got[:2] == [1.0, 2.0] and math.isnan(got[2])
    assert profile.column_quantiles(df.where("false"), ["v"], (0.5,)).first()["value"] is None
    row = compare.tail_quantile_error(df.where("v = 1"), df.where("false"), ["v"], (0.5,)).first()
    assert (row["q_p"], row["q_q"], row["abs_error"]) == (1.0, None, None)


def test_no_plan_buffers_a_column(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert profile.column_quantiles(df, ["v"], (0.5,)).first()["value"] == 499.5
    assert "percentile(" not in profile.column_quantiles(df, ["v"])._jdf.queryExecution().toString()
