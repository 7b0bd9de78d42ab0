"""Canonical JSON against the standard library's, and keys that order doesn't change."""

import hashlib
import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointgrain.functions.canonical import json_text
from pointgrain.operators import runs

KIND = "b string, a struct<z: double, y: array<long>, `x y`: boolean, m: map<string, array<struct<q: double, p: string>>>>, n map<string, int>, d double, i int"


def dumped(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def texts(spark, rows, kind=KIND):
    df = spark.createDataFrame(rows, kind)
    return [r[0] for r in df.select(json_text(F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema)).collect()]


def test_nested_rows(spark):
    rows = [
        {"b": 'q"\\/\n\t\b\f\r\x00\x7f é 世 😀', "a": {"z": 0.1, "y": [1, None, -3], "x y": True, "m": {"é": [{"q": 1e-7, "p": None}], "a": [], "B": None}}, "n": {"b": 1, "a": None, "é": 2, "\U0001f600": 3, "￿": 4}, "d": -0.0, "i": 7},
        {"b": "line\r", "a": None, "n": {"end\n": 1, "": 2}, "d": math.inf, "i": None}, {"b": None, "a": {"z": None, "y": None, "x y": None, "m": None}, "n": None, "d": None, "i": -1},
    ]
    assert texts(spark, rows) == [dumped(r) for r in rows]


def test_numbers(spark):
    some = [0.0, 1.0, 100.0, 0.1, 1e-4, 1e-5, 1.5e-5, 123456.789, 1e15, 1e16, 1.2e16, 1e22, 1e23, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 9007199254740993.0, 2.0e-3, 1 / 3, 4.35, 2**-44, 9.5, 99.99999999999999, -1e-10, 8.41e21, 2.2e-322, math.nan, -math.inf]
    assert texts(spark, [(x,) for x in some], "d double") == [dumped({"d": x}) for x in some]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(), st.text(st.characters(exclude_categories=["Cs"]), max_size=8), st.integers(-(2**63), 2**63 - 1)), min_size=40, max_size=80))
def test_any_number_and_text(spark, rows):
    assert texts(spark, rows, "f double, t string, i long") == [dumped({"f": f, "t": t, "i": i}) for f, t, i in rows]


def test_key_order_and_map_order_do_not_change_the_key(spark):
    a = spark.sql("SELECT struct(1 AS seed, map('x', 1.5D, 'y', 2D) AS m, struct('v' AS view, array(1, 2) AS k) AS f) AS c")
    b = spark.sql("SELECT struct(struct(array(1, 2) AS k, 'v' AS view) AS f, map('y', 2D, 'x', 1.5D) AS m, 1 AS seed) AS c")
    keys = [d.select(runs.run_key([F.lit("D5 x")], json_text(F.col("c"), d.schema["c"].dataType))).first()[0] for d in (a, b)]
    want = hashlib.sha256(dumped({"seed": 1, "m": {"x": 1.5, "y": 2.0}, "f": {"view": "v", "k": [1, 2]}}).encode()).hexdigest()[:12]
    assert keys == [f"D5-x__{want}"] * 2


def test_other_types_are_refused(spark):
    df = spark.sql("SELECT current_date() AS c, map(1, 2) AS m")
    for f in df.schema:
        with pytest.raises(TypeError):
            json_text(F.col(f.name), f.dataType)
