"""Invariants of views, transforms, densities, comparisons, samples, runs and outcomes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pointgrain.functions import expressions as X
from pointgrain.functions import targets as T
from pointgrain.operators import compare, dedup, density, outcomes, runs, sampling
from tests.conftest import SF


@pytest.fixture(scope="module")
def draws(spark):
    keys = spark.range(4000).withColumnRenamed("id", "row_id")
    return sampling.generate(keys, T.target("D4"), 13, 42).cache()


def one(df, expr):
    return df.agg(expr).first()[0]


def test_view_jacobians_match_finite_differences(spark):
    df = spark.createDataFrame([(1.2, -0.3, 12.0, -2.5, 0.7)], "px double, py double, pz double, x double, y double")
    for view, power in X.VIEW_POWER.items():
        assert one(df, F.max(X.view_log_jacobian(view, F.col("pz")))) == pytest.approx(-power * math.log(12.0))


def test_underflow_gives_minus_infinity_not_nan(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-inf, -inf), (-inf, 0.0), (-1000.0, -1000.0)], "a double, b double")
    got = [r[0] for r in df.select(X.logsumexp([F.col("a"), F.col("b")])).collect()]
    assert got[0] == -inf and got[1] == 0.0 and got[2] == pytest.approx(-1000 + math.log(2))


@pytest.mark.parametrize("name", ["D1", "D2", "D3", "D4", "D5"])
def test_posterior_sums_to_one_and_terms_to_the_density(spark, name):
    t = T.target(name)
    df = sampling.generate(spark.range(50).withColumnRenamed("id", "row_id"), t, -13, 5)
    terms = density.component_log_probs(t, -13)
    _, jac = t.inverse(T.state())
    lse = F.log(F.aggregate(F.transform(terms, F.exp), F.lit(0.0), lambda a, b: a + b)) + jac
    row = density.with_log_prob(df, t, "lp", -13).agg(F.max(F.abs(F.aggregate(density.posterior(terms), F.lit(-1.0), lambda a, b: a + b))), F.max(F.abs(lse - F.col("lp")))).first()
    assert row[0] < 1e-12 and row[1] < 1e-9


def test_draws_do_not_hang_on_partitioning(spark, draws):
    again = sampling.generate(spark.range(0, 4000, 1, 13).withColumnRenamed("id", "row_id"), T.target("D4"), 13, 42)
    assert draws.exceptAll(again).count() == 0


def test_component_frequencies_follow_the_weights(draws):
    n = {r["component_id"]: r["count"] for r in draws.groupBy("component_id").count().collect()}
    for k, c in enumerate(T.target("D4").components[13]):
        assert n[k] / 4000 == pytest.approx(c.weight, abs=4 * math.sqrt(c.weight / 4000))


def test_transform_returns(draws):
    t = T.target("D4")
    back, jac = t.inverse(T.state())
    there = draws.select(*(c.alias(n) for n, c in back.items()), "px", "x").toDF("b_px", "b_py", "b_pz", "b_x", "b_y", "px", "x")
    again = t.forward({c: F.col(f"b_{c}") for c in T.COLUMNS})
    assert one(there, F.max(F.abs(again["px"] - F.col("px")) + F.abs(again["x"] - F.col("x")))) < 1e-9


def test_rare_region_matches_its_calibration(spark):
    t = T.target("D5")
    df = sampling.generate(spark.range(40000).withColumnRenamed("id", "row_id"), t, 13, 3)
    base, _ = t.inverse(T.state())
    row = compare.region_calibration(df, t.region(13, base), F.col("component_id") == t.rare[13]).first()
    assert row["probability"] == pytest.approx(T.D5_CALIBRATION["rare_1e-2"][0], abs=5 * row["std_error"])
    assert row["contamination"] < 0.02


def test_stratified_draw_has_exact_counts_and_unbiased_weights(spark):
    t = T.target("D5")
    df = sampling.generate(spark.range(1000).withColumnRenamed("id", "row_id"), t, 13, 3, 100)
    rare = F.col("component_id") == 3
    assert df.where(rare).count() == 100
    row = sampling.stratum_weights(df, rare, 0.01, 0.1).agg(F.sum("sample_weight"), F.sum(F.when(rare, F.col("sample_weight")))).first()
    assert row[0] == pytest.approx(1000) and row[1] == pytest.approx(10)


def test_fits_and_saved_parameters(spark, draws, tmp_path):
    full = density.FullGaussian(T.COLUMNS).fit(draws)
    diag = density.DiagonalGaussian(T.COLUMNS).fit(draws)
    assert one(draws, F.avg(full.log_prob())) > one(draws, F.avg(diag.log_prob()))
    diag.save(spark, f"{tmp_path}/d")
    assert density.DiagonalGaussian.load(spark, f"{tmp_path}/d").mean == pytest.approx(diag.mean)
    assert full.sample(spark, 3000, 1).agg(F.avg("pz")).first()[0] == pytest.approx(full.mean[2], abs=0.6)


def test_kl_and_ess_reference_cases(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], "p double, q double")
    assert compare.forward_kl(df, "p", "q").first()["forward_kl"] == 0
    flat = df.withColumn("lw", F.lit(3.0))
    assert compare.importance_ess(flat, "lw").first()["ess_over_n"] == pytest.approx(1)
    a, b = (compare.importance_ess(df.withColumn("lw", F.col("p") + c), "lw").first()["ess_over_n"] for c in (0, 50))
    assert a == pytest.approx(b)
    two = spark.createDataFrame([(math.log(1.0),), (math.log(3.0),)], "lw double")
    assert compare.importance_ess(two, "lw").first()["ess_over_n"] == pytest.approx(16 / (2 * 10))
    with pytest.raises(ValueError):
        compare.importance_ess(spark.createDataFrame([(float("nan"),), (0.0,)], "lw double"), "lw")
    assert math.isnan(compare.held_out_nll(spark.createDataFrame([(float("inf"),)], "q double"), "q").first()["held_out_nll"])


def test_two_sample_test_tells_laws_apart(spark):
    keys = lambda a: spark.range(a, a + 1500).withColumnRenamed("id", "row_id")
    d2 = lambda i, a: sampling.generate(keys(a), T.target("D2"), i, 4)
    same = compare.c2st(d2(13, 0), d2(13, 5000), ["px", "py", "pz"], "row_id")
    other = compare.c2st(d2(13, 0), d2(13, 5000).withColumn("pz", F.col("pz") + 30), ["px", "py", "pz"], "row_id")
    assert abs(same["accuracy"] - 0.5) < 0.08 and other["accuracy"] > 0.9


def test_exact_binomial_interval():
    low, high = compare.clopper_pearson(5, 20)
    assert (low, high) == pytest.approx((0.08657, 0.49105), abs=1e-4)
    assert compare.clopper_pearson(0, 10)[0] == 0 and compare.clopper_pearson(10, 10)[1] == 1
    assert compare.clopper_pearson(0, 10)[1] == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)


def test_binomial_rates_contain_the_rate(spark):
    df = spark.createDataFrame([(i % 3, i % 4 == 0) for i in range(300)], "g int, ok boolean")
    for r in compare.binomial_rates(df, ["g"], F.col("ok")).collect():
        assert r["n"] == 100 and r["low"] < r["rate"] < r["high"]


def test_near_duplicates_against_all_pairs(spark):
    import random

    rnd = random.Random(1)
    pts = [(rnd.random(), rnd.random(), rnd.random()) for _ in range(300)]
    pts += [(x + 1e-3, y, z) for x, y, z in pts[:20]] + pts[50:60]
    want = sum(any(i != j and math.dist(p, q) < 0.01 for j, q in enumerate(pts)) for i, p in enumerate(pts))
    got = dedup.near_duplicates(spark.createDataFrame(pts, "a double, b double, c double"), ["a", "b", "c"], 0.01).first()
    assert (got["n_rows"], got["n_near"]) == (len(pts), want)


def test_splits_cover_and_have_the_right_size(spark):
    df = spark.range(1003).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 7)
    exact = sampling.exact_split(df, "k", 0.2, 5)
    assert exact.count() == 1003 and exact.where("part = 'validation'").count() == 201
    assert sampling.exact_split(df.repartition(9), "k", 0.2, 5).exceptAll(exact).count() == 0
    assert sampling.stratified_split(df, "k", "g", 0.2, 5).where("part = 'validation'").groupBy("g").count().count() == 7
    assert sampling.group_split(df, "g", 0.5, 5).groupBy("g").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        sampling.hash_split(df, "k", 1.0, 5)


def test_subset_keeps_extremes(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.sin(F.col("id")).alias("v"))
    for n in (1, 50, 900):
        sub = sampling.representative_subset(df, ["v"], "k", n, 3)
        assert sub.count() == min(max(n, 2), 500)
        assert sub.agg(F.min("v"), F.max("v")).first() == df.agg(F.min("v"), F.max("v")).first()


def test_gate_truth_table(spark):
    rows = [(0.009, 0.0, 0), (0.01, 0.0, 0), (None, 0.0, 0), (float("nan"), 0.0, 0), (0.5, 0.1, 0), (0.5, None, 0), (0.5, 0.0, -1), (0.5, 0.0, 2)]
    df = spark.createDataFrame(rows, "ess double, rate double, bad int")
    got = df.select(runs.gate_ess(F.col("ess"), 0.01), runs.gate_finiteness([F.lit(1.0)], [F.col("bad")], [F.col("rate")])).collect()
    assert [r[0] for r in got[:4]] == ["catastrophic", "pass", "inconclusive", "catastrophic"]
    assert [r[1] for r in got[4:]] == ["catastrophic", "inconclusive", "inconclusive", "catastrophic"]
    assert df.select(runs.gate_ess(F.lit(None).cast("double"), 0.01, F.lit(True))).first()[0] == "catastrophic"


def test_malformed_number_is_told_from_a_missing_one(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "raw string")
    got = [r[0] for r in df.select(runs.number_class(F.expr("try_cast(raw AS double)"), F.col("raw"))).collect()]
    assert got == ["finite", "malformed", "missing", "nonfinite"]


def test_run_scan_skips_and_tolerates(spark, tmp_path):
    from pyspark.sql import types as S

    for name, docs in {"a": {"status": {"run_id": "a"}, "config": {"seed": 1}}, "b": {"status": {"run_id": "b"}}, "c": {"config": {"seed": 2}}}.items():
        (tmp_path / name).mkdir()
        for kind, doc in docs.items():
            (tmp_path / name / f"{kind}.json").write_text(json.dumps(doc))
    (tmp_path / "b" / "config.json").write_text("{ not json")
    schemas = {"status": S.StructType([S.StructField("run_id", S.StringType())]), "config": S.StructType([S.StructField("seed", S.LongType())])}
    got = {r["run_dir"]: r["config"] for r in runs.read_runs(spark, str(tmp_path), schemas).collect()}
    assert set(got) == {"a", "b"} and got["a"]["seed"] == 1 and got["b"] is None


def test_report_sinks(spark, tmp_path):
    runs.write_report(spark.createDataFrame([("D0", 1)], "series string, n long"), f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/csv").first()["series"] == "D0"
    assert spark.read.json(f"{tmp_path}/r/json").first()["n"] == 1


def test_best_epoch_tolerance_is_sequential(spark):
    losses = [1.0, 1.0 - 6e-10, 1.0 - 1.2e-9, 2.0, 2.0, 0.5]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(losses)], "run string, epoch int, loss double")
    row = runs.best_epoch(df, "run", "epoch", "loss", 2).first()
    assert (row["best_epoch"], row["stop_epoch"]) == (2, 4)


def test_null_verdict_is_clean_and_unknown(spark):
    df = spark.createDataFrame([("completed", None, 1.0), ("completed", "catastrophic", 9.0), ("failed", "pass", 5.0)], "technical string, verdict string, ess double").withColumn("g", F.lit(1))
    row = runs.run_summary(df, ["g"], ["ess"]).first()
    assert (row["n"], row["n_unknown"], row["ess_mean"], row["ess_std"]) == (2, 1, 1.0, 0.0)


def test_scores_outside_the_unit_interval_fail(spark):
    df = spark.createDataFrame([(0.5,), (1.5,)], "s double")
    with pytest.raises(Exception, match="outside"):
        outcomes.checked_scores(df, "s").collect()


def test_leaky_fit_is_noticed(spark):
    """A fit on training rows does not move when validation rows change."""
    from pointgrain.operators.profile import fit_normalization
    from pointgrain.sources.tables import state_view

    rows = state_view(spark, SF).withColumn("v", F.col("x") > 0)
    a = fit_normalization(rows.where("NOT v"), ["px"]).first()
    b = fit_normalization(rows.withColumn("px", F.when(F.col("v"), F.col("px") * 9).otherwise(F.col("px"))).where("NOT v"), ["px"]).first()
    assert a == b


def test_impossible_rates_and_counts_leave_a_gate_open(spark):
    from pointgrain.operators import runs

    nan, inf = float("nan"), float("inf")
    rows = [(0.0, 0.0, "pass"), (0.0, 0.5, "catastrophic"), (2.0, 0.0, "catastrophic"), (1.5, 0.0, "inconclusive"), (-1.0, 0.0, "inconclusive"), (nan, 0.0, "inconclusive"), (0.0, nan, "inconclusive"), (0.0, inf, "inconclusive"), (0.0, 1.5, "inconclusive")]
    df = spark.createDataFrame(rows, "n double, rate double, want string")
    got = df.select("want", runs.gate_finiteness([F.lit(1.0)], [F.col("n")], [F.col("rate")]).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_series_have_variants_for_d5_only(spark):
    from pointgrain.operators import runs

    df = spark.createDataFrame([("D5", "rare_1e-2", "D5-1e-2"), ("D4", "rare_1e-2", "D4"), ("D5", None, "D5"), ("D5", "default", "D5")], "target string, variant string, want string")
    assert df.where(runs.series_label(F.col("target"), F.col("variant")) != F.col("want")).count() == 0


def test_a_threshold_may_not_contradict(spark):
    from pointgrain.operators import runs

    df = spark.createDataFrame([(0.1, None), (None, 0.2), (0.3, 0.3)], "a double, b double")
    assert [r[0] for r in df.select(runs.require_threshold(F.col("a"), F.col("b"))).collect()] == [0.1, 0.2, 0.3]
    with pytest.raises(Exception, match="contradicts"):
        df.select(runs.require_threshold(F.col("a"), F.lit(0.4))).collect()


def test_staged_density_equals_the_expression(spark):
    t = T.target("D1")
    df = sampling.generate(spark.range(50).withColumnRenamed("id", "row_id"), t, -13, 5)
    both = density.with_log_prob(df, t, "lp").withColumn("plain", X.logsumexp(t.component_terms(-13, T.state())))
    assert both.where(F.abs(F.col("lp") - F.col("plain")) > 1e-9).count() == 0


def test_staged_density_has_generated_code(spark):
    df = spark.createDataFrame([(1.0, 2.0, 50.0, 0.1, 0.2, 13)], "px double, py double, pz double, x double, y double, id int")
    plan = density.with_log_prob(df, T.target("D4"), "lp").select("lp")._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and len(plan) < 20_000


def test_interval_of_very_many_rows():
    low, high = compare.clopper_pearson(300_000_000, 1_000_000_000)
    width = 1.959963985 * math.sqrt(0.3 * 0.7 / 1e9)
    assert low == pytest.approx(0.3 - width, abs=1e-8) and high == pytest.approx(0.3 + width, abs=1e-8)
    tails = lambda p, ks: sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in ks)
    for k in (1, 7, 25, 49):
        low, high = compare.clopper_pearson(k, 50)
        assert tails(low, range(k, 51)) == pytest.approx(0.025, abs=1e-10) and tails(high, range(k + 1)) == pytest.approx(0.025, abs=1e-10)


def test_splits_over_many_ranges(spark, monkeypatch):
    """With narrow ranges the split is that of one order over all rows; a group with most rows is no exception."""
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("g"))
    code = {r[0]: (r[1], r[0]) for r in df.select("k", X.hash_code(F.col("k"), F.lit(5))).collect()}
    group = {r["k"]: r["g"] for r in df.collect()}
    monkeypatch.setattr(sampling, "RANGE_ROWS", 10)
    exact = {r["k"] for r in sampling.exact_split(df, "k", 0.2, 5).where("part = 'validation'").collect()}
    assert exact == set(sorted(code, key=code.get)[:600])
    want = set()
    for g in set(group.values()):
        own = sorted((k for k in group if group[k] == g), key=code.get)
        want |= set(own[: max(round(len(own) * 0.25), 1)])
    parts = sampling.stratified_split(df, "k", "g", 0.25, 5)
    assert parts.count() == 3000 and {r["k"] for r in parts.where("part = 'validation'").collect()} == want
    empty = df.where("k < 0")
    assert sampling.exact_split(empty, "k", 0.2, 5).count() == 0 and sampling.stratified_split(empty, "k", "g", 0.2, 5).count() == 0


def test_ranks_whatever_the_unit(spark):
    values = [(i * 37 % 211) * 1e-9 for i in range(1000)] + [float("inf"), float("-inf"), float("nan"), None]
    got = {repr(r["v"]): (r["n"], r["before"]) for r in sampling.value_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    there = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    assert got == {repr(v): (sum(repr(w) == repr(v) for w in there), min(i for i, w in enumerate(there) if repr(w) == repr(v))) for v in there}
    assert sampling.rank_transform(spark.createDataFrame([], "v double"), "v").count() == 0
