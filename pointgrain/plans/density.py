"""Queries on densities, posteriors and regions."""

from __future__ import annotations

import math
from uuid import uuid4

import numpy as np
from pyspark.sql import functions as F

from pointgrain.functions import expressions as X
from pointgrain.functions import targets as T
from pointgrain.operators import density
from pointgrain.operators.mixture import GaussianMixture
from pointgrain.plans import sql
from pointgrain.plans.contracts import rounded
from pointgrain.plans.views import _lnjac, _S, unbent
from pointgrain.sources.tables import STATE_SQL, shared_folder, state_view

P5 = sql.COLUMNS
D1, D2, D4, D5 = T.target("D1"), T.target("D2"), T.target("D4"), T.target("D5")


def _scores(t):
    def query(spark, sf_dir):
        return density.with_log_prob(state_view(spark, sf_dir), t, "log_prob").select("id", F.round("log_prob", 5).alias("log_prob"))

    return query


def diag_gauss_logpdf(spark, sf_dir):
    d0 = T.D0
    lp = X.diag_gauss_logpdf([F.col(c) for c in P5], d0["mean"], [s * s for s in d0["std"]])
    return state_view(spark, sf_dir).select(F.round(lp, 5).alias("log_prob"))


def _arrays(df, column):
    return df.withColumn(column, F.transform(column, lambda v: F.round(v, 5)))


def component_logpdf(spark, sf_dir):
    return _arrays(state_view(spark, sf_dir).select("id", T.by_id("id", lambda i: density.component_log_probs(D2, i)).alias("terms")), "terms").select("id", F.col("terms")[0].alias("term0"), F.col("terms")[1].alias("term1"))


def component_posterior(spark, sf_dir):
    post = state_view(spark, sf_dir).select("id", density.posterior(T.by_id("id", lambda i: density.component_log_probs(D2, i))).alias("p"))
    return post.select("id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


def posterior_mass(spark, sf_dir):
    """Mean posterior of each component by id."""
    terms = T.by_id("id", lambda i: density.component_log_probs(D2, i))
    return rounded(density.mean_posterior(state_view(spark, sf_dir), terms, ["id"]), "mass")


def _region(t, i):
    base, _ = t.inverse(T.state())
    return t.region(i, base)


def mahalanobis_filter(spark, sf_dir):
    """Rows within 3 deviations of the D1 Gaussian."""
    inside = X.mahalanobis_sq([F.col(c) for c in P5], T.D1_MEAN, T.D1_COVARIANCE) <= 81.0
    return rounded(state_view(spark, sf_dir).where(inside).select(*P5), *P5)


def region_mask(spark, sf_dir):
    """How many rows lie in the rare region, seen through the inverse transform, by id."""
    wide = state_view(spark, sf_dir).select("id", T.by_id("id", lambda i: _region(D5, i)).alias("inside"))
    return wide.groupBy("id").agg(F.count("*").alias("n_rows"), F.count_if("inside").alias("n_inside"))


def weighted_moments(spark, sf_dir):
    return rounded(density.weighted_moments(state_view(spark, sf_dir), P5, "w"), "mean", "var")


def weighted_cov(spark, sf_dir):
    return rounded(density.weighted_cov(state_view(spark, sf_dir), P5, "w"), "cov")


def component_counts(spark, sf_dir):
    """Rows by most probable D2 component."""
    return density.component_counts(state_view(spark, sf_dir), T.by_id("id", lambda i: density.component_log_probs(D2, i)), ["id"])


def mixture_reloaded(spark, sf_dir):
    """Log densities under a mixture that was saved and read back; it is laid by in the session's shared folder."""
    model, path = GaussianMixture.of_target(D2, 13), f"{shared_folder(spark)}/mixture-{uuid4().hex}"
    model.save(spark, path)
    return GaussianMixture.load(spark, path).with_log_prob(state_view(spark, sf_dir)).select(F.round("log_prob", 5).alias("log_prob"))


def _terms(t, i, columns=P5):
    return [f"({math.log(c.weight)!r} + {sql.gauss(columns, c.mean, c.cov)})" for c in t.components[i]]


def _base(t, cells=None):
    """SQL of the base coordinates and of the inverse log-Jacobian."""
    flat = unbent(t.banana)
    back = {c: flat[c] if not b else f"{a!r} * sinh({-b!r} + asinh(({flat[c]}) / {a!r}))" for c, (a, b) in _S.items()} if t.scales else flat
    return back, _lnjac(flat, -1) if t.scales else "0e0"


def _logpdf_sql(t, transformed):
    back, jac = _base(t) if transformed else ({c: c for c in P5}, "0e0")
    inner = f"(SELECT id, {', '.join(f'{e} AS {c}' for c, e in back.items())}, {jac} AS jac FROM {STATE_SQL})"
    terms = f"(SELECT id, jac, CASE WHEN id = 13 THEN [{', '.join(_terms(t, 13))}] ELSE [{', '.join(_terms(t, -13))}] END AS t FROM {inner})"
    return f"SELECT id, round(list_max(t) + ln(list_sum(list_transform(t, lambda v: exp(v - list_max(t))))) + jac, 5) AS log_prob FROM {terms}"


_D2T = f"(SELECT id, CASE WHEN id = 13 THEN [{', '.join(_terms(D2, 13))}] ELSE [{', '.join(_terms(D2, -13))}] END AS t FROM {STATE_SQL})"
_D2P = f"(SELECT id, list_transform(t, lambda v: exp(v - (list_max(t) + ln(list_sum(list_transform(t, lambda q: exp(q - list_max(t)))))))) AS p FROM {_D2T})"
_D5B = f"(SELECT id, {', '.join(f'{e} AS {c}' for c, e in _base(D5)[0].items())} FROM {STATE_SQL})"
_IN = {i: f"{sql.quadratic(P5, T.D5_RARE_MEAN[i], np.diag(1 / np.square(T.D5_RARE_STD)))} <= {T.D5_RADIUS_SQ!r}" for i in T.IDS}

QUERIES = {
    "full_gauss_logpdf": _scores(D1), "mixture_logpdf": _scores(D2),
    "transformed_logpdf": _scores(D4), "base_stage_logpdf": _scores(T.target("D5", base=True)),
} | {f.__name__: f for f in (diag_gauss_logpdf, component_logpdf, component_posterior, posterior_mass, mahalanobis_filter, region_mask, weighted_moments, weighted_cov, component_counts, mixture_reloaded)}
ORACLE_SQL = {
    "full_gauss_logpdf": _logpdf_sql(D1, False),
    "mixture_logpdf": _logpdf_sql(D2, False),
    "transformed_logpdf": _logpdf_sql(D4, True),
    "base_stage_logpdf": _logpdf_sql(D5, False),
    "mixture_reloaded": f"SELECT round({sql.lse(_terms(D2, 13))}, 5) AS log_prob FROM {STATE_SQL}",
    "diag_gauss_logpdf": f"SELECT round({sql.gauss(P5, T.D0['mean'], np.diag(np.square(T.D0['std'])))}, 5) AS log_prob FROM {STATE_SQL}",
    "component_logpdf": f"SELECT id, round(t[1], 5) AS term0, round(t[2], 5) AS term1 FROM {_D2T}",
    "component_posterior": f"SELECT id, round(p[1], 6) AS p0, round(p[2], 6) AS p1 FROM {_D2P}",
    "posterior_mass": f"SELECT id, 0 AS component_id, round(avg(p[1]), 6) AS mass FROM {_D2P} GROUP BY id UNION ALL SELECT id, 1, round(avg(p[2]), 6) FROM {_D2P} GROUP BY id",
    "mahalanobis_filter": f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in P5)} FROM {STATE_SQL} WHERE {sql.quadratic(P5, T.D1_MEAN, np.linalg.inv(np.asarray(T.D1_COVARIANCE)))} <= 81",
    "region_mask": f"SELECT id, count(*) AS n_rows, count_if(CASE WHEN id = 13 THEN {_IN[13]} ELSE {_IN[-13]} END)::BIGINT AS n_inside FROM {_D5B} GROUP BY id",
    "weighted_moments": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(any_value(m), 6) AS mean, round(greatest(sum(w * ({c} - m) ** 2) / sum(w), 1e-6), 6) AS var FROM {STATE_SQL}, (SELECT sum(w * {c}) / sum(w) AS m FROM {STATE_SQL})" for c in P5),
    "weighted_cov": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(w * ({a} - ma) * ({b} - mb)) / sum(w){' + 1e-6' if a == b else ''}, 6) AS cov FROM {STATE_SQL}, (SELECT sum(w * {a}) / sum(w) AS ma, sum(w * {b}) / sum(w) AS mb FROM {STATE_SQL})" for i, a in enumerate(P5) for b in P5[i:]),
    "component_counts": f"SELECT id, CASE WHEN t[1] >= t[2] THEN 0 ELSE 1 END AS component_id, count(*) AS n FROM {_D2T} GROUP BY ALL",
}
