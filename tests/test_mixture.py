"""The mixture estimator and the Gaussians behind the same interface."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrain.functions import targets as T
from pointgrain.operators import density, sampling
from pointgrain.operators.mixture import GaussianMixture


def drawn(spark, n=2000, seed=8):
    return sampling.generate(spark.range(n).withColumnRenamed("id", "row_id"), T.target("D2"), 13, seed)


def plain_log_prob(model, x):
    out = []
    for w, m, c in zip(model.weights, model.means, model.covariances, strict=True):
        gap = x - m
        out.append(math.log(w) - 0.5 * (len(m) * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", gap, np.linalg.inv(c), gap)))
    return np.logaddexp.reduce(out, axis=0)


def test_both_components_are_found_and_validation_rows_scored(spark):
    df = drawn(spark)
    model = GaussianMixture(["px", "pz"], 2, n_init=2).fit(df, validation=drawn(spark, 500, 9), seed=1)
    assert sum(model.weights) == pytest.approx(1) and sorted(model.means[:, 1]) == pytest.approx([45, 60], abs=2.5)
    r = model.result
    assert r.converged and r.seed == 1 and 1 < r.steps < 200 and r.warnings == ()
    assert r.validation_nll == pytest.approx(r.train_nll, abs=0.3)
    points = np.array(df.select("px", "pz").collect())
    assert r.train_nll == pytest.approx(-plain_log_prob(model, points).mean(), rel=1e-9)
    assert GaussianMixture(["px", "pz"], 2, max_iter=1).fit(df).result.warnings == ("no convergence in 1 steps",)


def test_a_step_is_that_of_plain_expectation_maximization(spark):
    df = drawn(spark, 300).withColumn("w", F.lit(0.5) + F.col("row_id") % 3)
    x, w = np.array(df.select("px", "py", "pz").collect()), np.array(df.select("w").collect())[:, 0]
    a = GaussianMixture(["px", "py", "pz"], 3, max_iter=1).fit(df, weight="w", seed=4)
    b = GaussianMixture(["px", "py", "pz"], 3, max_iter=2).fit(df, weight="w", seed=4)
    terms = np.array([math.log(p) - 0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) for p, m, c in zip(a.weights, a.means, a.covariances, strict=True)])
    share = np.exp(terms - np.logaddexp.reduce(terms, axis=0)) * w
    n = share.sum(1)
    means = share @ x / n[:, None]
    cov = np.array([((x - m).T * s) @ (x - m) / k for m, s, k in zip(means, share, n, strict=True)]) + 1e-6 * np.eye(3)
    assert b.weights == pytest.approx(n / n.sum()) and b.means == pytest.approx(means) and b.covariances == pytest.approx(cov, rel=1e-7, abs=1e-9)


def test_fits_hang_neither_on_order_nor_on_partitions(spark):
    df = drawn(spark, 500)
    a, b = (GaussianMixture(["px", "pz"], 2).fit(d, seed=3) for d in (df.repartition(1), df.orderBy(F.desc("px")).repartition(7)))
    assert a.means == pytest.approx(b.means, rel=1e-9) and a.covariances == pytest.approx(b.covariances, rel=1e-9)


def test_weights_count_as_copies_and_bad_ones_are_refused(spark):
    df = drawn(spark, 400).withColumn("w", (F.col("row_id") % 3).cast("double"))
    weighted = density.FullGaussian(["px", "pz"]).fit(df, weight="w")
    copies = density.FullGaussian(["px", "pz"]).fit(df.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(2)))).where("c <= w"))
    assert weighted.mean == pytest.approx(copies.mean) and np.array(weighted.var) == pytest.approx(np.array(copies.var))
    one = GaussianMixture(["px", "pz"], 1, max_iter=3).fit(df, weight="w")
    assert one.means[0] == pytest.approx(copies.mean) and one.covariances[0] == pytest.approx(np.array(copies.var), rel=1e-4)
    for bad in (F.lit(-1.0), F.lit(float("nan")), F.lit(0.0)):
        for model in (GaussianMixture(["px"], 2), density.DiagonalGaussian(["px"]), density.FullGaussian(["px"])):
            with pytest.raises(ValueError, match="weights"):
                model.fit(df.withColumn("w", bad), weight="w")
    with pytest.raises(ValueError, match="finite"):
        GaussianMixture(["px"], 2).fit(df.withColumn("px", F.when(F.col("row_id") > 0, F.col("px"))))


def test_nearly_singular_data_have_a_floor(spark):
    """Columns that hang on each other, a constant one, and a third of all rows at one point."""
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.sin("id") * 1e3).alias("a")).select("a", (F.col("a") * 2 + 1e-9).alias("b"), F.lit(28.9).alias("c"))
    model = GaussianMixture(["a", "b", "c"], 3, n_init=2).fit(df, seed=2)
    assert all(np.linalg.eigvalsh(c).min() > 5e-7 for c in model.covariances)
    assert math.isfinite(model.result.train_nll)
    assert model.with_log_prob(df).where("isnan(log_prob) OR log_prob IS NULL").count() == 0
    assert GaussianMixture(["a"], 4).fit(df.limit(2)).result.parameter_count == 11


@pytest.mark.parametrize("make", [lambda: GaussianMixture(["px", "pz"], 2), lambda: density.FullGaussian(["px", "pz"]), lambda: density.DiagonalGaussian(["px", "pz"])])
def test_saved_models_score_and_draw_alike(spark, tmp_path, make):
    df = drawn(spark, 300)
    model = make().fit(df, seed=1)
    model.save(spark, f"{tmp_path}/m")
    again = type(model).load(spark, f"{tmp_path}/m")
    both = again.with_log_prob(model.with_log_prob(df, "a"), "b")
    assert both.where("a <> b").count() == 0
    assert model.sample(spark, 100, 7).exceptAll(again.sample(spark, 100, 7)).count() == 0
    assert again.parameter_count() == model.result.parameter_count == {"GaussianMixture": 11, "FullGaussian": 5, "DiagonalGaussian": 4}[type(model).__name__]


def test_draws_follow_the_mixture(spark):
    model = GaussianMixture.of_target(T.target("D2"), 13)
    draws = model.sample(spark, 6000, 5)
    n = {r["component_id"]: r["count"] for r in draws.groupBy("component_id").count().collect()}
    assert [n[k] / 6000 for k in range(2)] == pytest.approx(model.weights, abs=0.03)
    again = density.FullGaussian(T.COLUMNS).fit(draws.where("component_id = 1"))
    assert again.mean == pytest.approx(model.means[1], abs=0.6) and np.array(again.var) == pytest.approx(model.covariances[1], abs=2)
    with pytest.raises(RuntimeError, match="not fitted"):
        GaussianMixture(["px"], 2).sample(spark, 1, 1)
