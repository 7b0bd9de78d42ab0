"""Views with errors, coverage, gate summaries, selection and the scorer, as a user calls them on own tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrain.operators import coverage, outcomes, runs, sampling, views
from pointgrain.operators.scorer import Scorer, pooled

NAN = float("nan")
STATE = "px double, py double, pz double, x double, y double"


def one_row(spark, **cells):
    return spark.createDataFrame([tuple(({"px": 1.0, "py": -2.0, "pz": 30.0, "x": 0.5, "y": 0.25} | cells).values())], STATE)


@pytest.mark.parametrize("view", ["identity", "logpz", "slope"])
def test_views_there_and_back(spark, view):
    there = views.to_features(one_row(spark), view, 2.0, "f_")
    back = views.from_features(there.drop("px", "py", "pz", "x", "y"), view, 2.0, "f_").select("px", "py", "pz", "x", "y").first()
    assert list(back) == pytest.approx([1.0, -2.0, 30.0, 0.5, 0.25])
    with pytest.raises(Exception, match="not defined"):
        views.to_features(one_row(spark, x=NAN), view, 2.0, "f_").collect()


@pytest.mark.parametrize("view", ["logpz", "slope"])
@pytest.mark.parametrize("pz", [0.0, -0.1])
def test_log_views_refuse_pz_that_is_not_positive(spark, view, pz):
    with pytest.raises(Exception, match="not defined"):
        views.to_features(one_row(spark, pz=pz), view, 1.0, "f_").collect()
    assert views.to_features(one_row(spark, pz=pz), "identity", 1.0, "f_").first()["f_pz"] == pz


@pytest.mark.parametrize("view", ["logpz", "slope"])
@pytest.mark.parametrize("log_pz", [1e4, -1e4, NAN])
def test_inverse_out_of_its_domain_is_an_error(spark, view, log_pz):
    names = [f"f_{n}" for n in views.VIEWS[view]]
    df = spark.createDataFrame([(0.0, 0.0, log_pz, 0.0, 0.0)], ", ".join(f"{n} double" for n in names))
    with pytest.raises(Exception, match="leaves its domain"):
        views.from_features(df, view, 1.0, "f_").collect()


def test_pipeline_is_saved_as_numbers(spark, tmp_path):
    df = spark.range(50).select(F.sin("id").alias("px"), F.cos("id").alias("py"), (F.col("id") + 1.0).alias("pz"), (F.col("id") / 7).alias("x"), F.sin(F.col("id") * 3).alias("y"))
    pipe = views.FeaturePipeline("slope", 0.5).fit(df)
    pipe.save(spark, f"{tmp_path}/p")
    again = views.FeaturePipeline.load(spark, f"{tmp_path}/p")
    assert again.fitted == pipe.fitted and again.view == "slope" and again.unit == 0.5
    z = again.transform(df)
    assert z.agg(F.avg("z_tx"), F.stddev_pop("z_log_pz")).first()[:] == pytest.approx((0, 1), abs=1e-9)
    back = again.inverse(z.select(*(F.col(c).alias(f"o_{c}") for c in ("px", "pz")), *(f"z_{n}" for n in views.VIEWS["slope"])))
    assert back.where("abs(px - o_px) + abs(pz - o_pz) > 1e-9").count() == 0
    # Numeric derivative of the feature map at a row against the density's change of coordinates.
    row = z.select(again.physical_log_prob(F.lit(0.0)).alias("lp"), "pz").first()
    assert row["lp"] == pytest.approx(-sum(math.log(s) for _, s in pipe.fitted.values()) - 3 * math.log(row["pz"]))
    with pytest.raises(ValueError, match="scale"):
        views.momentum_score(0.0)


def test_coverage_fingerprints_hang_on_the_rows_alone(spark):
    rows = [(i, 1.0, 1.0, -1.0 if i % 5 == 0 else 2.0, NAN if i % 7 == 0 else 0.0, 0.0) for i in range(70)]
    df = spark.createDataFrame(rows, f"key long, {STATE}")
    report = lambda d: {(r["arm"], r["valid"], r["reason"]): (r["n"], r["fingerprint"]) for r in coverage.domain_coverage(d, "key").collect()}
    a = report(df)
    assert a == report(df.repartition(7).orderBy(F.desc("key")))
    n = {k: v[0] for k, v in a.items()}
    assert n["identity", None, None] == 70 and n["identity", False, "nonfinite"] == 10 and n["logpz", False, "pz_not_positive"] == 12 and n["common", True, None] == 48
    assert a["logpz", True, None] == a["common", True, None] and a["logpz", False, None][1] != a["identity", False, None][1]
    assert report(df.withColumn("key", F.when(F.col("key") == 3, 1000).otherwise(F.col("key"))))["common", True, None] != a["common", True, None]
    assert coverage.common_valid(df).count() == 48 and coverage.domain_coverage(df.where("false"), "key").count() == 0
    assert {r["arm"]: r["n_valid"] for r in coverage.native_coverage(df).collect()} == {"identity": 60, "logpz": 48, "slope": 48}


def test_gate_summary_lists_are_bounded_and_lose_no_run(spark):
    rows = [(f"r{i:03d}", "failed" if i % 10 == 0 else "completed", ("catastrophic", "inconclusive", "pass", None)[i % 4], "pilot", "D5-rare" if i % 3 == 0 else "D4", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id string, technical string, verdict string, scope string, target string, rare_count int")
    one, rest = runs.gate_summary(df.repartition(5), most=7)
    r = one.first()
    assert (r["n_runs"], r["decision_scope"], r["technical_counts"], r["verdict_counts"]) == (200, ["pilot"], {"completed": 180, "failed": 20}, {"catastrophic": 50, "inconclusive": 50, "pass": 50})
    want = {"catastrophic": [x[0] for x in rows if x[2] == "catastrophic"], "inconclusive": [x[0] for x in rows if x[2] == "inconclusive"], "zero_rare": [x[0] for x in rows if x[4].startswith("D5") and x[5] == 0]}
    beyond = {}
    for x in rest.collect():
        beyond.setdefault(x["kind"], []).append(x["run_id"])
    for kind, ids in want.items():
        assert r[f"n_{kind}"] == len(ids) and r[f"{kind}_runs"] == ids[:7] and sorted(beyond[kind]) == ids[7:]
    whole, none = runs.gate_summary(df)
    assert whole.first()["zero_rare_runs"] == want["zero_rare"] and none.count() == 0
    empty = runs.gate_summary(df.where("false"))[0].first()
    assert empty["n_runs"] == 0 and empty["catastrophic_runs"] == [] and empty["n_zero_rare"] == 0 and empty["decision_scope"] == []


def test_selection_functions(spark):
    df = spark.range(100).select("id", (F.col("id") % 10).alias("cell"), F.col("id").cast("double").alias("v"))
    assert sampling.take(df, df.where("id < 5"), "id").count() == 5 and sampling.leave(df, df.where("id < 5"), "id").count() == 95
    assert sampling.tail_mask(df, df, "v", 0.95).where("tail").count() == 5
    assert sampling.tail_mask(df.where("false"), df, "v", 0.5).where("tail IS NULL").count() == 100
    assert sampling.weight_shares(df, "v", "cell").groupBy("cell").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-12").count() == 0
    best = sampling.acquire_diverse(df.withColumn("cell", F.when(F.col("id") > 50, 0).otherwise(F.col("cell"))), "v", "id", "cell", 12, 2).collect()
    assert [r["id"] for r in best][:3] == [99, 98, 49] and len(best) == 12
    assert [r["id"] for r in sampling.acquire_top(df, "v", "id", 2).collect()] == [99, 98]


def test_pooling_is_the_closest_rising_sequence():
    assert pooled(np.ones(5), np.array([1.0, 3.0, 2.0, 2.0, 5.0])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])
    assert pooled(np.array([1.0, 3.0]), np.array([1.0, 0.0])).tolist() == [0.25, 0.25]
    assert pooled(np.zeros(0), np.zeros(0)).tolist() == []


def labelled(spark, n=6000):
    """The label's rate is no logistic function of the column: steep in the middle and never near 0 or 1."""
    u = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    x = (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20) - 0.5) * 8
    rate = F.lit(0.2) + F.when(x > 1, 0.6).when(x > 0, 0.3).otherwise(0.0)
    return spark.range(n).select("id", x.alias("a"), (F.sin("id") * 100).alias("b"), rate.alias("rate"), (u < rate).cast("int").alias("label"), (1 + F.col("id") % 2).cast("double").alias("w"))


def test_scores_are_reliable_and_come_back(spark, tmp_path):
    df = labelled(spark)
    model = Scorer(["a", "b"]).fit(df, "label", "w")
    fresh = labelled(spark, 12000).where("id >= 6000")
    scored = model.score(fresh)
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    for r in outcomes.calibration(scored, "score", F.col("label") == 1, 5).where("n > 300").collect():
        assert r["predicted"] == pytest.approx(r["observed"], abs=0.06)
    assert scored.agg(F.avg(F.abs(F.col("score") - F.col("rate")))).first()[0] < 0.06
    raw = fresh.withColumn("score", model.raw())
    assert raw.agg(F.avg(F.abs(F.col("score") - F.col("rate")))).first()[0] > 0.07
    model.save(spark, f"{tmp_path}/s")
    again = Scorer.load(spark, f"{tmp_path}/s")
    assert again.score(scored.withColumnRenamed("score", "first")).where("score <> first").count() == 0
    assert model.is_physical is False and model.score(df.withColumn("a", F.lit(NAN))).where("score IS NOT NULL").count() == 0


def test_weights_of_a_scorer_count(spark):
    df = labelled(spark, 3000).withColumn("w", F.when(F.col("label") == 1, 9.0).otherwise(1.0))
    heavy, plain = (Scorer(["a"]).fit(df, "label", w).score(df).agg(F.avg("score")).first()[0] for w in ("w", None))
    assert heavy > plain + 0.2


@pytest.mark.parametrize(("change", "what"), [({"label": None}, "labels"), ({"label": 2}, "labels"), ({"a": NAN}, "cells"), ({"w": -1.0}, "weights"), ({"w": 0.0}, "both labels")])
def test_bad_rows_are_refused(spark, change, what):
    (column, value), = change.items()
    df = labelled(spark, 50).withColumn(column, F.lit(value).cast("double"))
    with pytest.raises(ValueError, match=what):
        Scorer(["a"]).fit(df, "label", "w")
    with pytest.raises(RuntimeError, match="not fitted"):
        Scorer(["a"]).score(df)
