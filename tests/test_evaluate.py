"""The evaluation bundle: one scan, weights on any scale, and every part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrain.operators import compare, evaluate


def rows_of(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def table(spark, log_w, n_p=7):
    rows = [(True, 0.0, 0.5, 1.0, i) for i in range(n_p)] + [(False, w, 0.0, float(i), i) for i, w in enumerate(log_w)]
    return spark.createDataFrame(rows, "p boolean, log_p double, log_q double, x double, k long")


@pytest.mark.parametrize("shift", [0.0, 700.0, -5000.0, 1e6])
def test_weights_are_summed_on_any_scale(spark, shift):
    rng = np.random.default_rng(4)
    log_w = np.r_[rng.normal(size=300) * 40, -1e4, 3.0] + shift
    got = rows_of(evaluate.evaluate(table(spark, [*log_w.tolist(), math.nan, math.inf, -math.inf]).repartition(6), F.col("p"), evaluate.Plan(["x"])))
    w = np.exp(log_w - log_w.max())
    assert got["ess.ess_over_n"] == pytest.approx(w.sum() ** 2 / (len(w) * (w * w).sum()), rel=1e-9)
    assert got["ess.max_weight"] == pytest.approx(1 / w.sum(), rel=1e-9) and got["ess.n_excluded"] == 3
    assert (got["ess.log_min"], got["ess.log_max"]) == (log_w.min(), log_w.max())


def test_bundle_reads_its_table_once(spark, tmp_path):
    table(spark, [0.0, 1.0]).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = evaluate.aggregates(df, F.col("p"), evaluate.Plan(["x"], thresholds={"x": 0.5}, inside=F.col("x") > 0, target_mass=0.1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "InMemoryTableScan" not in plan


def test_empty_sides_and_odd_rows(spark):
    got = rows_of(evaluate.evaluate(table(spark, [], 0), F.col("p"), evaluate.Plan(["x"], thresholds={"x": 0.0}, levels=(0.5,), atol=0.1)))
    assert math.isnan(got["held_out.nll"]) and got["held_out.n"] == 0 and got["ess.ess_over_n"] is None and got["ess.catastrophic"] == 1
    assert got["exceedance.x.p"] is None and got["tail.x.0.5.p"] is None and got["duplicates.n_rows"] == got["near_duplicates.n_near"] == 0
    odd = table(spark, [0.0, 0.0, 0.0]).withColumn("x", F.when(F.col("p") | (F.col("k") > 0), F.col("x")).otherwise(F.lit(math.nan)))
    got = rows_of(evaluate.evaluate(odd, F.col("p"), evaluate.Plan(["x"], inside=F.col("x") > 1.5, target_mass=0.5)))
    assert got["support.nonfinite_rate"] == pytest.approx(1 / 3) and got["ess.n_excluded"] == 1
    assert got["rare.mass"] == pytest.approx(1 / 3) and got["rare.p_zero"] == 0.125


def test_two_sample_test_is_a_part_of_it(spark):
    df = spark.range(1200).select((F.col("id") % 2 == 0).alias("p"), F.lit(0.0).alias("log_p"), F.lit(0.0).alias("log_q"), (F.hash("id") % 97 + F.when(F.col("id") % 2 == 0, 60).otherwise(0)).cast("double").alias("x"), "id")
    got = rows_of(evaluate.evaluate(df, F.col("p"), evaluate.Plan(["x"], key="id", seed=3)))
    want = compare.c2st(df.where("p"), df.where("NOT p"), ["x"], "id", 3)
    assert got["c2st.accuracy"] == pytest.approx(want["accuracy"]) and got["c2st.auc"] == pytest.approx(want["auc"]) and got["c2st.accuracy"] > 0.55


def test_soft_posterior_counts_whole_rows(spark):
    df = table(spark, [0.0] * 4)
    soft = F.col("x") / 10
    got = rows_of(evaluate.evaluate(df, F.col("p"), evaluate.Plan(["x"], soft=soft, posterior=F.array(soft, 1 - soft), n_components=2)))
    assert got["rare.soft_mass"] == pytest.approx(0.15) and got["posterior.0"] == pytest.approx(0.1) and got["posterior.1"] == pytest.approx(0.9)
    row = compare.rare_region(df, F.col("x") > 1, 0.2, posterior=soft).first()
    assert row["soft_mass"] == pytest.approx(df.agg(F.avg("x")).first()[0] / 10)
