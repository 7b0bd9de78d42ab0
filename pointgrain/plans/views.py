"""Queries on feature views, transforms and scalar scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointgrain.functions import expressions as X
from pointgrain.functions import targets
from pointgrain.operators import coverage, profile, views
from pointgrain.operators.views import MUON_MASS
from pointgrain.plans import sql
from pointgrain.plans.contracts import TRAIN_SQL, faulty, rounded, train_state
from pointgrain.sources.tables import STATE_SQL, state_view, table

P5 = sql.COLUMNS
D4 = targets.target("D4")


def _round(df):
    return rounded(df, *(c for c, t in df.dtypes if t == "double"))


def _view(view, unit=1.0):
    return lambda spark, sf_dir: _round(state_view(spark, sf_dir).select(*(c.alias(n) for n, c in X.view_forward(view, unit).items())))


def view_roundtrip(spark, sf_dir):
    """Physical columns after forward and inverse of each view."""
    state = state_view(spark, sf_dir)
    parts = []
    for view, unit in (("identity", 1.0), ("logpz", 2.0), ("slope", 0.5)):
        features = state.select(*(c.alias(n) for n, c in X.view_forward(view, unit).items()))
        back = X.view_inverse(view, {n: F.col(n) for n in X.VIEWS[view]}, unit)
        parts.append(features.select(F.lit(view).alias("view"), *(c.alias(n) for n, c in back.items())))
    return _round(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def view_logjac(spark, sf_dir):
    return _round(state_view(spark, sf_dir).select("pz", *(X.view_log_jacobian(v, F.col("pz")).alias(v) for v in X.VIEWS)))


def _pipeline(spark, sf_dir, view):
    """Fitted (mean, std) of a view's features on the training rows."""
    features = train_state(spark, sf_dir).select(*(c.alias(n) for n, c in X.view_forward(view).items()))
    return profile.fit_normalization(features, X.VIEWS[view], "error")


def pipeline_fit(spark, sf_dir):
    return _round(_pipeline(spark, sf_dir, "slope"))


def standardize_view(spark, sf_dir):
    """Standardized features of the slope view, and the largest error of the way back."""
    fitted = profile.parameters(_pipeline(spark, sf_dir, "slope"))
    cells = profile.standardized(X.view_forward("slope"), fitted)
    z = state_view(spark, sf_dir).select(*P5[:3], *(c.alias(f"z_{n}") for n, c in cells.items()))
    back = X.view_inverse("slope", profile.standardized({n: F.col(f"z_{n}") for n in X.VIEWS["slope"]}, fitted, inverse=True))
    miss = F.greatest(*(F.abs(back[c] - F.col(c)) for c in P5[:3])) < 1e-9
    return _round(z.select(*(f"z_{n}" for n in X.VIEWS["slope"]), miss.alias("returns")))


def _feature_logpdf(cells):
    return X.diag_gauss_logpdf(list(cells.values()), [0.0] * 5, [1.0] * 5)


def physical_log_prob(spark, sf_dir):
    """Density in physical coordinates from one in the logpz view, which has unit variance around (0, 0, 4, 0, 0)."""
    f = X.view_forward("logpz")
    lp = X.diag_gauss_logpdf(list(f.values()), [0.0, 0.0, 4.0, 0.0, 0.0], [100.0, 9.0, 1.0, 4.0, 4.0])
    return _round(state_view(spark, sf_dir).select(views.physical_log_prob(lp, "logpz").alias("log_prob")))


def pipeline_log_prob(spark, sf_dir):
    pipe = views.FeaturePipeline("slope").fit(train_state(spark, sf_dir))
    scored = pipe.transform(state_view(spark, sf_dir)).withColumn("lp", _feature_logpdf({n: F.col(f"z_{n}") for n in X.VIEWS["slope"]}))
    return _round(scored.select(pipe.physical_log_prob(F.col("lp")).alias("log_prob")))


def _transform(make):
    return lambda spark, sf_dir: _round(state_view(spark, sf_dir).select(*(c.alias(n) for n, c in make(targets.state()).items())))


def banana_roundtrip(spark, sf_dir):
    bent = state_view(spark, sf_dir).select(*P5, *(c.alias(f"f_{n}") for n, c in X.banana(targets.D3_BANANA, targets.state()).items()))
    back = X.banana(targets.D3_BANANA, {n: F.col(f"f_{n}") for n in P5}, inverse=True)
    return _round(bent.select(*(f"f_{n}" for n in P5), F.greatest(*(F.abs(back[n] - F.col(n)) for n in P5)).alias("miss")).withColumn("miss", F.col("miss") < 1e-9))


def skew_roundtrip(spark, sf_dir):
    args = (targets.D4_SCALES, targets.D4_SKEWS)
    bent = state_view(spark, sf_dir).select(*P5, *(c.alias(f"f_{n}") for n, c in X.skew(*args, targets.state()).items()))
    back = X.skew(*args, {n: F.col(f"f_{n}") for n in P5}, inverse=True)
    return _round(bent.select(*(f"f_{n}" for n in P5), F.greatest(*(F.abs(back[n] - F.col(n)) for n in P5)).alias("miss")).withColumn("miss", F.col("miss") < 1e-9))


def skew_logjac(spark, sf_dir):
    args = (targets.D4_SCALES, targets.D4_SKEWS)
    return _round(state_view(spark, sf_dir).select(X.skew_log_jacobian(*args, targets.state()).alias("log_jacobian")))


def composed_logjac(spark, sf_dir):
    """Inverse log-Jacobian of the composed transform, taken at the intermediate point."""
    _, jac = D4.inverse(targets.state())
    return _round(state_view(spark, sf_dir).select(jac.alias("log_jacobian")))


def domain_coverage(spark, sf_dir):
    """Rows, finite rows and valid rows by view, over all rows and over those valid in every view."""
    fin = F.lit(True)
    for c in P5:
        fin = fin & X.finite(c)
    valid = {"identity": fin, "logpz": fin & (F.col("pz") > 0), "slope": fin & (F.col("pz") > 0)}
    one = faulty(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_if(fin).alias("n_finite"), *(F.count_if(v).alias(n) for n, v in valid.items()), F.count_if(valid["identity"] & valid["slope"]).alias("n_common"))
    rows = [F.struct(F.lit(n).alias("view"), "n_rows", "n_finite", F.col(n).alias("n_valid"), "n_common") for n in valid]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def common_valid(spark, sf_dir):
    return _round(coverage.common_valid(faulty(spark, sf_dir)).select(*P5))


def native_coverage(spark, sf_dir):
    return _round(coverage.native_coverage(faulty(spark, sf_dir)))


def coverage_report(spark, sf_dir):
    """Counts, reasons and key fingerprints of each arm and of all arms together, from one pass."""
    keyed = table(spark, sf_dir, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS key", *(f"{sql.FAULTS[c]} AS {c}" for c in P5))
    return coverage.domain_coverage(keyed, "key")


def angles(spark, sf_dir):
    """Polar and azimuth angle; null where the direction is not defined."""
    return _round(state_view(spark, sf_dir).select(*(c.alias(n) for n, c in views.angles().items())))


def energy(spark, sf_dir):
    return _round(state_view(spark, sf_dir).select(views.energy().alias("energy")))


def score_momentum(spark, sf_dir, scale: float = 50.0):
    """Placeholder score p / (p + scale) of no physical meaning."""
    return _round(state_view(spark, sf_dir).select(views.momentum_score(scale).alias("score")))


def pipeline_roundtrip(spark, sf_dir):
    """Standardized features of a fitted pipeline, and the physical columns that its checked inverse gives back."""
    pipe = views.FeaturePipeline("logpz", 2.0).fit(train_state(spark, sf_dir))
    there = pipe.transform(state_view(spark, sf_dir)).select(*(f"z_{n}" for n in X.VIEWS["logpz"]))
    return _round(pipe.inverse(there).select(*P5))


_SLOPE = "px / pz AS tx, py / pz AS ty, ln(pz) AS log_pz, x, y"
_FEATURES = ("tx", "ty", "log_pz", "x", "y")
_FIT = f"(SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _FEATURES)} FROM (SELECT {_SLOPE} FROM {TRAIN_SQL}))"
_Z = {c: f"({c} - m_{c}) / s_{c}" for c in _FEATURES}
_B, _S = targets.D3_BANANA, dict(zip(P5, zip(targets.D4_SCALES, targets.D4_SKEWS, strict=True), strict=True))
_SKEWED = {c: c if b == 0 else f"{a!r} * sinh({b!r} + asinh({c} / {a!r}))" for c, (a, b) in _S.items()}


def _lnjac(columns, sign):
    return " + ".join(f"(ln(cosh({sign * b!r} + asinh(({columns[c]}) / {a!r}))) - 0.5 * ln(1 + (({columns[c]}) / {a!r}) ** 2))" for c, (a, b) in _S.items() if b)


def unbent(p):
    u = f"(px / {p['scale_px']!r})"
    return {"px": "px", "py": f"py - {p['curvature'] * p['scale_py']!r} * {u} * {u}", "pz": "pz", "x": f"x - {p['shear'] * p['scale_x']!r} * {u}", "y": "y"}


def _rounds(cells, source=STATE_SQL):
    return "SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in cells.items()) + f" FROM {source}"


_FIN = " AND ".join(map(sql.ok, P5))
QUERIES = {"view_identity": _view("identity"), "view_logpz": _view("logpz", 2.0), "view_slope": _view("slope")} | {
    f.__name__: f for f in (view_roundtrip, view_logjac, pipeline_fit, standardize_view, physical_log_prob, pipeline_log_prob, banana_roundtrip, skew_roundtrip, skew_logjac, composed_logjac, domain_coverage, common_valid, native_coverage, coverage_report, angles, energy, score_momentum, pipeline_roundtrip)
}
_U = f"(px / {_B['scale_px']!r})"
ORACLE_SQL = {
    "view_identity": _rounds({c: c for c in P5}),
    "view_logpz": _rounds({"px": "px", "py": "py", "log_pz": "ln(pz / 2e0)", "x": "x", "y": "y"}),
    "view_slope": _rounds({"tx": "px / pz", "ty": "py / pz", "log_pz": "ln(pz)", "x": "x", "y": "y"}),
    "view_roundtrip": " UNION ALL ".join(f"SELECT '{v}' AS view, {', '.join(f'round({c}, 6) AS {c}' for c in P5)} FROM {STATE_SQL}" for v in X.VIEWS),
    "view_logjac": _rounds({"pz": "pz", "identity": "0e0", "logpz": "-ln(pz)", "slope": "-3 * ln(pz)"}),
    "pipeline_fit": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(m_{c}, 6) AS mean, round(s_{c}, 6) AS std FROM {_FIT}" for c in _FEATURES),
    "standardize_view": f"SELECT {', '.join(f'round({e}, 6) AS z_{c}' for c, e in _Z.items())}, true AS returns FROM (SELECT {_SLOPE} FROM {STATE_SQL}), {_FIT}",
    "physical_log_prob": f"SELECT round({sql.gauss(('px', 'py', 'ln(pz)', 'x', 'y'), (0.0, 0.0, 4.0, 0.0, 0.0), [[v if i == j else 0.0 for j in range(5)] for i, v in enumerate((100.0, 9.0, 1.0, 4.0, 4.0))])} - ln(pz), 6) AS log_prob FROM {STATE_SQL}",
    "pipeline_log_prob": f"SELECT round({-2.5 * math.log(2 * math.pi)!r} - 0.5 * ({' + '.join(f'({e}) ** 2' for e in _Z.values())}) - ({' + '.join(f'ln(s_{c})' for c in _FEATURES)}) - 3 * log_pz, 6) AS log_prob FROM (SELECT {_SLOPE} FROM {STATE_SQL}), {_FIT}",
    "banana_roundtrip": _rounds({"f_px": "px", "f_py": f"py + {_B['curvature'] * _B['scale_py']!r} * {_U} * {_U}", "f_pz": "pz", "f_x": f"x + {_B['shear'] * _B['scale_x']!r} * {_U}", "f_y": "y"}).replace(" FROM", ", true AS miss FROM", 1),
    "skew_roundtrip": _rounds({f"f_{c}": e for c, e in _SKEWED.items()}).replace(" FROM", ", true AS miss FROM", 1),
    "skew_logjac": _rounds({"log_jacobian": _lnjac({c: c for c in P5}, 1)}),
    "composed_logjac": _rounds({"log_jacobian": _lnjac(unbent(targets.D4_BANANA), -1)}),
    "domain_coverage": " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS n_rows, count_if({_FIN})::BIGINT AS n_finite, count_if({_FIN}{'' if v == 'identity' else ' AND pz > 0'})::BIGINT AS n_valid, count_if({_FIN} AND pz > 0)::BIGINT AS n_common FROM {sql.FAULTY_SQL}" for v in X.VIEWS),
    "common_valid": _rounds({c: c for c in P5}, f"{sql.FAULTY_SQL} WHERE {_FIN} AND pz > 0"),
    "native_coverage": " UNION ALL ".join(f"SELECT '{v}' AS arm, count(*) AS n_rows, count_if({_FIN}{'' if v == 'identity' else ' AND pz > 0'})::BIGINT AS n_valid, round(count_if({_FIN}{'' if v == 'identity' else ' AND pz > 0'}) / count(*), 6) AS coverage FROM {sql.FAULTY_SQL}" for v in X.VIEWS),
    "coverage_report": f"""WITH f AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, {', '.join(f'{sql.FAULTS[c]} AS {c}' for c in P5)} FROM lineitem),
k AS (SELECT ('0x' || substr(md5(key), 1, 15))::BIGINT AS code, CASE WHEN NOT ({_FIN}) THEN 'nonfinite' END AS a, CASE WHEN NOT ({_FIN}) THEN 'nonfinite' WHEN pz <= 0 THEN 'pz_not_positive' END AS b FROM f),
r AS (SELECT code, 'identity' AS arm, a AS reason FROM k UNION ALL SELECT code, 'logpz', b FROM k UNION ALL SELECT code, 'slope', b FROM k UNION ALL SELECT code, 'common', CASE WHEN b IS NOT NULL THEN 'outside an arm' END FROM k),
g AS (SELECT arm, NULL::BOOLEAN AS valid, NULL::VARCHAR AS reason, code FROM r UNION ALL SELECT arm, reason IS NULL, NULL, code FROM r UNION ALL SELECT arm, false, reason, code FROM r WHERE reason IS NOT NULL)
SELECT arm, valid, reason, count(*) AS n, sha256(count(*) || '|' || sum(code)::VARCHAR) AS fingerprint FROM g GROUP BY ALL""",
    "pipeline_roundtrip": _rounds({c: c for c in P5}),
    "angles": _rounds({"theta": "atan2(sqrt(px * px + py * py), pz)", "phi": "CASE WHEN px = 0 AND py = 0 THEN 0 ELSE atan2(py, px) END"}),
    "energy": _rounds({"energy": f"sqrt(px * px + py * py + pz * pz + {MUON_MASS**2!r})"}),
    "score_momentum": _rounds({"score": "sqrt(px * px + py * py + pz * pz) / (sqrt(px * px + py * py + pz * pz) + 50)"}),
}
