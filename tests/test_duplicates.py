"""Duplicates and near duplicates together: room on disk, the grid, and its ways for few and for crowded homes."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrain.operators import dedup, evaluate
from tests.test_neighbours import families, plain

NAMES = ["a", "b", "c"]


def written(spark):
    """Bytes that shuffles have written so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def in_shared(spark):
    return sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if f.is_file())


def test_room_on_disk(spark, monkeypatch):
    """Points without many near ones, in many cells: shuffles stay in proportion, and nothing is left in the shared folder."""
    monkeypatch.setattr(dedup, "CELL", 512)
    monkeypatch.setattr(dedup, "FEW", 0, raising=False)
    n = 20_000
    df = spark.range(n).select(*((F.rand(i) * w).alias(f"c{i}") for i, w in enumerate((50.0, 11.0, 104.0, 2.0, 1.5)))).localCheckpoint()
    shuffled, left = written(spark), in_shared(spark)
    assert dedup.near_duplicates(df, df.columns, 0.5).first()["n_rows"] == n
    assert in_shared(spark) == left
    assert written(spark) - shuffled < 250 * n


def test_bundle_leaves_nothing_in_the_shared_folder(spark):
    df = spark.range(600).select((F.col("id") % 2 == 0).alias("p"), F.lit(0.0).alias("log_p"), F.lit(0.0).alias("log_q"), (F.col("id") * 0.7).alias("x"))
    left = in_shared(spark)
    got = {r["metric"]: r["value"] for r in evaluate.evaluate(df, F.col("p"), evaluate.Plan(["x"], atol=1.5)).collect()}
    assert (got["duplicates.n_rows"], got["duplicates.n_duplicates"], got["near_duplicates.n_near"]) == (300, 0, 300)
    assert in_shared(spark) == left


@pytest.mark.parametrize(("few", "crowd"), [(0, 4), (0, 0), (500_000, 0)])
@pytest.mark.parametrize("name", ["all", "lattice"])
def test_every_way_against_all_pairs(spark, monkeypatch, name, few, crowd):
    """Homes shuffled or not; cells parted by the grid alone, or by the tree as soon as they have more points than CELL."""
    for what, value in (("CELL", 16), ("FEW", few), ("CROWD", crowd)):
        monkeypatch.setattr(dedup, what, value)
    points = families()[name]
    points = np.r_[points, points[:20]].tolist()
    df = spark.createDataFrame([tuple(p) for p in points], NAMES)
    row = dedup.duplicates(df, NAMES, 0.1).first()
    assert (row["n_rows"], row["n_near"]) == (len(points), plain(points, 0.1))
    assert row[:3] == dedup.exact_duplicates(df, NAMES).first()[:]


def test_packed_cells_are_told_apart(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(int, r)) for r in rng.choice([-(10**9), -1, 0, 1, 10**9], (400, 6))]
    df = spark.createDataFrame(rows, [f"k{i}" for i in range(6)])
    keys = dedup.packed(df, [F.col(c) for c in df.columns])
    assert len(keys) == 3 and df.select(*keys).distinct().count() == len(set(rows))
    narrow = df.select(*((F.col(c) % 2).alias(c) for c in df.columns))
    assert len(dedup.packed(narrow, [F.col(c) for c in df.columns])) == 1
    assert dedup.packed(df.where("false"), [F.col("k0")])


def test_grid_takes_the_columns_that_part_points():
    on, width, cells = dedup.grid({"a": 2, "b": 50, "c": 1, "d": 100}, 500)
    assert on == ["d", "b"] and (1 + 99 * 4 / width) * (1 + 49 * 4 / width) == pytest.approx(cells) and cells >= 500
    on, width, cells = dedup.grid({"a": 1, "b": 1}, 1e9)
    assert cells == 1 and len(on) == 1
    for k in (1, 5, 50):
        on, width, _ = dedup.grid({f"c{i}": 1000 for i in range(k)}, 1e30)
        assert (1 + 2 / width) ** len(on) <= dedup.REPEATS and len(on) <= dedup.MOST


@pytest.mark.parametrize("at", [0.0, 1.0])
def test_values_that_most_points_have_are_not_at_borders(spark, monkeypatch, at):
    """Columns that are all but constant: were that value at a border, each point would go to two cells a column."""
    monkeypatch.setattr(dedup, "CELL", 16)
    n, sent = 800, []
    df = spark.range(n).select((F.col("id") * 0.3).alias("a"), *(F.when(F.col("id") % 40 == i, F.lit(float(i + 3))).otherwise(F.lit(at)).alias(f"b{i}") for i in range(6)))
    frame = type(df)
    count = frame.count
    monkeypatch.setattr(frame, "count", lambda self: sent.append((self.columns, count(self))) or sent[-1][1])
    assert dedup.near_duplicates(df, df.columns, 0.1).first()[:] == (n, 0)
    assert max(x for c, x in sent if "cell" in c) < 2 * n


def test_exact_duplicates_of_the_bundle_keep_their_type(spark):
    """Whole numbers beyond 2^53 that are one double are near, but no duplicates."""
    df = spark.createDataFrame([(False, 0.0, 0.0, (1 << 53) + i) for i in (0, 1, 2, 2, 40)], "p boolean, log_p double, log_q double, x long")
    got = {r["metric"]: r["value"] for r in evaluate.evaluate(df, F.col("p"), evaluate.Plan(["x"], atol=0.5)).collect()}
    assert (got["duplicates.n_rows"], got["duplicates.n_distinct"], got["near_duplicates.n_near"]) == (5, 4, 4)
