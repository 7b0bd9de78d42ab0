"""Near duplicates against all pairs, with cells forced to be small."""

import numpy as np
import pytest

from pointgrain.operators import dedup


def plain(points, atol):
    x = np.array(points)
    near = 0
    for i in range(len(x)):
        d = np.square(x - x[i]).sum(1)
        d[i] = np.inf
        near += d.min(initial=np.inf) < atol * atol
    return int(near)


def families():
    rng = np.random.default_rng(6)
    agree = np.c_[np.full(300, 1.5), np.full(300, -2.0), rng.uniform(0, 40, 300)]
    lattice = np.c_[rng.integers(0, 12, 400), rng.integers(0, 12, 400), rng.integers(0, 3, 400)] * 0.1
    spot = rng.normal(size=(300, 3)) * 0.02 + 3
    wide = rng.normal(size=(300, 3)) * 10.0 ** rng.integers(-2, 5, (300, 1))
    line = np.c_[np.arange(200) * 0.0999999, np.zeros(200), np.zeros(200)]
    return {"agree": agree, "lattice": lattice, "spot": spot, "wide": wide, "line": line, "copies": np.r_[wide[:5], wide[:5], wide[:5], spot[:50]], "all": np.r_[agree, lattice, spot, wide, line]}


@pytest.mark.parametrize("name", list(families()))
@pytest.mark.parametrize("cell", [4096, 16])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, name, cell):
    monkeypatch.setattr(dedup, "CELL", cell)
    points = families()[name].tolist()
    df = spark.createDataFrame([tuple(p) for p in points], "a double, b double, `c.d` double")
    row = dedup.near_duplicates(df, ["a", "b", "c.d"], 0.1).first()
    assert (row["n_rows"], row["n_near"]) == (len(points), plain(points, 0.1))


def test_no_cell_holds_more_than_its_number_of_points(spark, monkeypatch):
    """Points that agree in two columns, and a dense cloud; homes of a cell that can't be cut are few by construction."""
    monkeypatch.setattr(dedup, "CELL", 32)
    rng = np.random.default_rng(1)
    points = np.r_[np.c_[np.zeros(900), np.zeros(900), rng.uniform(0, 500, 900)], rng.uniform(0, 30, (900, 3))]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "p0 double, p1 double, p2 double")
    cells = dedup.dealt(df, df, ["p0", "p1", "p2"], 0.1).groupBy("cell").count().collect()
    assert max(r["count"] for r in cells) <= 2 * 32 and sum(r["count"] for r in cells) < 3 * 2 * len(points)


def test_odd_points(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, 1.0), (nan, 1.0), (nan, 2.0), (inf, 1.0), (None, 1.0), (None, 1.0), (1e300, 0.0), (1e300, 0.0), (1e300, 0.01), (5.0, 5.0), (-1e12, 3.0), (-1e12, 3.05)]
    assert dedup.near_duplicates(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 0.1).first()[:] == (12, 9)
    assert dedup.near_duplicates(spark.createDataFrame([], "a double, b double"), ["a", "b"], 0.1).first()[:] == (0, 0)


def plain_nearest(rows, asked, unit=False):
    x = {k: np.array(v, float) for k, v in rows}
    if unit:
        whole = np.array([v for _, v in rows])
        std = whole.std(0)
        x = {k: (v - whole.mean(0)) / np.where(std > 0, std, 1) for k, v in x.items()}
    return {q: min(float(np.sqrt(np.square(x[q] - v).sum())) for k, v in x.items() if k != q) for q in asked}


@pytest.mark.parametrize("unit", [False, True])
@pytest.mark.parametrize("sizes", [(64, 8192, 8192), (5, 7, 3)])
def test_nearest_rows_against_all(spark, monkeypatch, unit, sizes):
    from pointgrain.operators import neighbours

    for name, value in zip(("PIVOTS", "TILE", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    points = np.r_[rng.normal(size=(150, 6)) + np.repeat(np.eye(6) * 30, 25, 0), np.tile(rng.normal(size=6), (40, 1)), rng.normal(size=(30, 6)) * 1e6]
    points[:, 5] = 2.0
    rows = [(f"k{i}", p.tolist()) for i, p in enumerate(points)]
    odd = [("null", None), ("nan", [float("nan")] * 6), ("short", [1.0]), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "k string, v array<double>").repartition(4)
    got = {r["k"]: r for r in neighbours.nn_spread(df, "v", df.where("k LIKE '%0' OR k LIKE '%3' OR k IN ('null', 'nan', 'short')"), "k", unit).collect()}
    want = plain_nearest(rows, [k for k, _ in rows if k[-1] in "03"], unit)
    assert set(got) == set(want) and all(got[k]["distance"] == pytest.approx(want[k], rel=1e-12, abs=1e-15) for k in want)
    assert all(1 <= r["visited"] <= len(rows) for r in got.values())
    if sizes[0] == 64 and not unit:
        assert np.mean([r["visited"] for r in got.values()]) < 0.6 * len(rows)
    assert neighbours.nn_summary(neighbours.nn_spread(df.where("false"), "v", df, "k")).first()["n"] == 0
    assert neighbours.nn_spread(df.where("k = 'k1'"), "v", df.where("k = 'k1'"), "k").count() == 0
