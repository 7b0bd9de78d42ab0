"""Queries that compare two samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pointgrain.functions import targets as T
from pointgrain.functions.expressions import hash_uniform
from pointgrain.operators import compare, dedup, density, evaluate, neighbours
from pointgrain.plans import sql
from pointgrain.plans.contracts import faulty, rounded
from pointgrain.plans.density import _IN, _terms
from pointgrain.sources.tables import STATE_SQL, state_view, table

P5 = sql.COLUMNS
D1, D2, D5 = T.target("D1"), T.target("D2"), T.target("D5")
THRESHOLDS = {"px": 10.0, "py": 2.0, "pz": 60.0}


def scored(spark, sf_dir):
    """State rows with log p under the D1 and log q under the D2 target; every 97th order has a NaN."""
    lines = table(spark, sf_dir, "lineitem").select("*")
    from pointgrain.sources.tables import STATE_SELECT, _items

    rows = lines.selectExpr("l_orderkey", *_items(STATE_SELECT))
    both = density.with_log_prob(density.with_log_prob(rows, D1, "log_p", 13), D2, "log_q")
    return both.withColumn("log_q", F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("log_q")))


def _sides(spark, sf_dir):
    state = state_view(spark, sf_dir)
    return state.where("side = 'F'"), state.where("side = 'O'")


def _round(df, digits=5):
    return rounded(df, *(c for c, t in df.dtypes if t == "double"), digits=digits)


def held_out_nll(spark, sf_dir):
    return _round(compare.held_out_nll(scored(spark, sf_dir), "log_q"))


def forward_kl(spark, sf_dir):
    return _round(compare.forward_kl(scored(spark, sf_dir), "log_p", "log_q"))


def importance_ess(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("lw", (F.col("log_p") - F.col("log_q")) / 100)
    return _round(compare.importance_ess(df, "lw", drop=True))


def weight_ess(spark, sf_dir):
    return _round(compare.weight_ess(state_view(spark, sf_dir), "w"), 3)


def tail_quantile_error(spark, sf_dir):
    return _round(compare.tail_quantile_error(*_sides(spark, sf_dir), P5))


def exceedance_error(spark, sf_dir):
    return _round(compare.exceedance_error(*_sides(spark, sf_dir), THRESHOLDS))


def nonfinite_rate(spark, sf_dir):
    return _round(compare.nonfinite_rate(scored(spark, sf_dir), "log_q"))


def support_violation(spark, sf_dir):
    return _round(compare.support_violation(faulty(spark, sf_dir), P5))


def _wide(spark, sf_dir):
    """State rows stretched so that some reach the rare region of id 13."""
    return scored(spark, sf_dir).withColumns({"x": F.col("x") / 4 + 2.5, "y": F.col("y") / 4 - 2.5})


def rare_region(spark, sf_dir):
    inside = D5.region(13, T.state())
    found = compare.rare_region(_wide(spark, sf_dir), inside, 0.01, F.col("log_p"), F.col("log_q"), None, F.col("id") == 13)
    return _round(found)


def region_calibration(spark, sf_dir):
    return _round(compare.region_calibration(_wide(spark, sf_dir), D5.region(13, T.state()), F.col("id") == 13))


def histogram_pull(spark, sf_dir):
    return _round(compare.histogram_pull(*_sides(spark, sf_dir), "px", -25.0, 25.0, 20))


def labelled_union(spark, sf_dir):
    return compare.labelled_union(*_sides(spark, sf_dir), P5).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("px"), 3).alias("sum_px"))


def stratum_nll(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"nll": -F.col("log_p"), "rare": F.col("id") == 13})
    return _round(compare.stratum_nll(df, "nll", "w", "rare"), 4)


def binomial_rates(spark, sf_dir):
    """Share of errors among each user's events, with exact intervals."""
    return _round(compare.binomial_rates(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error"), 6)


def binomial_counts(spark, sf_dir):
    """The counts and rates of binomial_rates, which SQL can tell."""
    return binomial_rates(spark, sf_dir).drop("low", "high")


def c2st(spark, sf_dir):
    """Two-sample test of large against small events on their hour and weekday."""
    e = table(spark, sf_dir, "events").select("event_id", F.hour("ts").cast("double").alias("hour"), F.dayofweek("ts").cast("double").alias("day"), "event_type")
    found = compare.c2st(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), ["hour", "day"], "event_id")
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


def mixture_fit(spark, sf_dir):
    """Weights of a two-component mixture fitted to the state rows."""
    model = density.mixture_fit(state_view(spark, sf_dir), ["px", "py", "pz"], 2)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights)], "component_id int, weight double")


def bootstrap_metric(spark, sf_dir):
    return _round(compare.bootstrap_metric(table(spark, sf_dir, "events"), "value", "event_id", 20))


def exact_duplicates(spark, sf_dir):
    return dedup.exact_duplicates(state_view(spark, sf_dir).select(F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "side"), ["px", "py", "side"])


ATOL = 0.02


def near_duplicates(spark, sf_dir):
    """Events whose value and second of the day lie close to another one's."""
    e = table(spark, sf_dir, "events").select("value", (F.col("event_id") * 7919 % 5000 / 100).alias("v"))
    return dedup.near_duplicates(e, ["value", "v"], ATOL)


def out_of_support(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _round(dedup.out_of_support(train, test, ["value"]), 9)


def _split(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("u", hash_uniform(F.col("event_id"), F.lit(5)))
    return e.where("u < 0.1"), e.where("u >= 0.1")


def support_class(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return dedup.support_class(train, test, ["value"], 5.0, 20).groupBy("support").agg(F.count("*").alias("n"))


def nn_spread(spark, sf_dir):
    """Nearest other embedding of each embedding whose id is divisible by 20, over all embeddings and coordinates."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _round(neighbours.nn_spread(e, "embedding", e.where("vec_id % 20 = 0"), "vec_id").select("vec_id", "distance"))


def nn_summary(spark, sf_dir):
    """The summary of such distances between normalized embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nn_spread(e, "embedding", e.where("vec_id % 20 = 0"), "vec_id", normalized=True)
    return _round(neighbours.nn_summary(found).drop("visited"), 4)


def evaluate_bundle(spark, sf_dir):
    """All metrics of the scored rows of one side against the other's as (metric, value), but for the two-sample test."""
    rows = _wide(spark, sf_dir).withColumn("terms", T.by_id("id", lambda i: density.component_log_probs(D2, i))).withColumn("post", density.posterior(F.col("terms")))
    post = F.col("post")
    plan = evaluate.Plan(
        P5, log_weight=(F.col("log_p") - F.col("log_q")) / 100, weight="w", thresholds=THRESHOLDS, levels=(0.01, 0.99), posterior=post, n_components=2,
        inside=D5.region(13, T.state()), soft=F.get(post, F.lit(0)), rare=F.col("id") == 13, target_mass=0.01, atol=0.5,
    )
    return _round(evaluate.evaluate(rows, F.col("side") == "F", plan), 5)


def evaluate_classifier(spark, sf_dir):
    """The bundle's two-sample test: the p side against the q side by a classifier."""
    plan = evaluate.Plan(("px", "py", "pz"), key="l_orderkey")
    return evaluate.evaluate(scored(spark, sf_dir), F.col("side") == "F", plan).where("metric LIKE 'c2st%'")


_LP, _LQ = _terms(D1, 13)[0], f"CASE WHEN id = 13 THEN {sql.lse(_terms(D2, 13))} ELSE {sql.lse(_terms(D2, -13))} END"
_SCORED = f"(SELECT *, {_LP} AS log_p, CASE WHEN l_orderkey % 97 = 0 THEN 'NaN'::DOUBLE ELSE {_LQ} END AS log_q FROM {STATE_SQL.replace('SELECT', 'SELECT l_orderkey,', 1)})"
_WIDE = f"(SELECT * REPLACE (x / 4 + 2.5 AS x, y / 4 - 2.5 AS y) FROM {_SCORED})"
_PQ = f"(SELECT *, side = 'F' AS is_p FROM {STATE_SQL})"
_LW = f"(SELECT (log_p - log_q) / 100 AS lw FROM {_SCORED})"
_ESS = f"""WITH l AS {_LW}, f AS (SELECT lw FROM l WHERE {sql.ok('lw')}), m AS (SELECT max(lw) AS top, min(lw) AS low FROM f),
a AS (SELECT sum(exp(lw - top)) AS s, sum(exp(2 * (lw - top))) AS s2, count(*) AS n, any_value(top) AS top, any_value(low) AS low FROM f, m)"""
_H = f"(SELECT least(floor((px + 25) / 2.5), 19)::INT AS bin, count_if(side = 'F') AS n_p, count_if(side = 'O') AS n_q FROM {STATE_SQL} WHERE px BETWEEN -25 AND 25 GROUP BY 1)"
_U5 = sql.uniform("event_id", 5)
_UNIT = """(WITH c AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY i),
l AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM m) SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: (x - l.m[i]) / l.s[i]) AS v FROM embeddings, l)"""
_NEAREST_UNIT = f"(WITH u AS MATERIALIZED {_UNIT} SELECT q.vec_id, min(list_distance(q.v, e.v)) AS distance FROM u q JOIN u e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)"
_NEAREST = "(SELECT q.vec_id, min(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS distance FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)"

QUERIES = {f.__name__: f for f in (held_out_nll, forward_kl, importance_ess, weight_ess, tail_quantile_error, exceedance_error, nonfinite_rate, support_violation, rare_region, region_calibration, histogram_pull, labelled_union, stratum_nll, binomial_rates, binomial_counts, c2st, mixture_fit, bootstrap_metric, exact_duplicates, near_duplicates, out_of_support, support_class, nn_spread, nn_summary, evaluate_bundle, evaluate_classifier)}
ORACLE_SQL = {
    "held_out_nll": f"SELECT round(avg(CASE WHEN {sql.ok('log_q')} THEN -log_q END), 5) AS held_out_nll, count_if(NOT {sql.ok('log_q')})::BIGINT AS n_nonfinite, count(*) AS n FROM {_SCORED}",
    "forward_kl": f"SELECT round(avg(d), 5) AS forward_kl, round(stddev_pop(d) / sqrt(count(d)), 5) AS std_error, count(d) AS n_finite, count_if(d IS NULL)::BIGINT AS n_nonfinite FROM (SELECT CASE WHEN {sql.ok('log_p - log_q')} THEN log_p - log_q END AS d FROM {_SCORED})",
    "importance_ess": f"{_ESS} SELECT round(s * s / (n * s2), 5) AS ess_over_n, round(1 / s, 5) AS max_weight, round(low, 5) AS log_min, round(top, 5) AS log_max, round(top - low, 5) AS log_range, (SELECT count_if(NOT {sql.ok('lw')}) FROM l)::BIGINT AS n_nonfinite, s * s / (n * s2) < 0.01 AS catastrophic FROM a",
    "weight_ess": f"SELECT round(sum(w) ** 2 / sum(w * w), 3) AS ess, count(*) AS n FROM {STATE_SQL}",
    "tail_quantile_error": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {l!r}::DOUBLE AS level, round(a, 5) AS q_p, round(b, 5) AS q_q, round(abs(a - b), 5) AS abs_error FROM (SELECT quantile_cont({c}, {l!r}) FILTER (side = 'F') AS a, quantile_cont({c}, {l!r}) FILTER (side = 'O') AS b FROM {STATE_SQL})" for c in P5 for l in (0.01, 0.99)),
    "exceedance_error": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(a, 5) AS p_p, round(b, 5) AS p_q, round(abs(a - b), 5) AS abs_error FROM (SELECT avg(({c} > {t!r})::INT) FILTER (is_p) AS a, avg(({c} > {t!r})::INT) FILTER (NOT is_p) AS b FROM {_PQ})" for c, t in THRESHOLDS.items()),
    "nonfinite_rate": f"SELECT count_if(NOT {sql.ok('log_q')})::BIGINT AS n_nonfinite, count(*) AS n, round(count_if(NOT {sql.ok('log_q')}) / count(*), 5) AS rate FROM {_SCORED}",
    "support_violation": f"SELECT round(avg((NOT ({' AND '.join(map(sql.ok, P5))}))::INT), 5) AS nonfinite_rate, round(avg((pz <= 0)::INT), 5) AS pz_rate, count_if(pz <= 0)::BIGINT AS n_pz FROM {sql.FAULTY_SQL}",
    "rare_region": f"""WITH s AS (SELECT *, {_IN[13]} AS hit FROM {_WIDE}), a AS (SELECT count(*) AS n, count_if(hit)::BIGINT AS n_inside,
avg(log_q) FILTER (id = 13 AND {sql.ok('log_q')}) AS rare_log_q, avg(log_p - log_q) FILTER (id = 13 AND {sql.ok('log_p - log_q')}) AS rare_kl FROM s)
SELECT n, n_inside, round(rare_log_q, 5) AS rare_log_q, round(rare_kl, 5) AS rare_kl, round(n_inside / n, 5) AS mass, round(n_inside / n / 0.01, 5) AS mass_ratio, round(pow(0.99, n), 5) AS p_zero, n_inside = 0 AS zero FROM a""",
    "region_calibration": f"WITH a AS (SELECT count(*) AS n, count_if(hit)::BIGINT AS k, count_if(hit AND id <> 13) AS o FROM (SELECT id, {_IN[13]} AS hit FROM {_WIDE})) SELECT n, k AS n_inside, round(k / n, 5) AS probability, round(sqrt(k / n * (1 - k / n) / n), 5) AS std_error, round(coalesce(o / nullif(k, 0), 0), 5) AS contamination FROM a",
    "histogram_pull": f"""WITH f AS (SELECT range::INT AS bin, coalesce(n_p, 0)::BIGINT AS n_p, coalesce(n_q, 0)::BIGINT AS n_q FROM range(20) LEFT JOIN {_H} ON bin = range),
t AS (SELECT *, sum(n_p) OVER () * 2.5e0 AS tp, sum(n_q) OVER () * 2.5e0 AS tq FROM f), e AS (SELECT *, sqrt((sqrt(n_p) / tp) ** 2 + (sqrt(n_q) / tq) ** 2) AS e FROM t)
SELECT bin, n_p, n_q, round(n_p / tp, 5) AS d_p, round(n_q / tq, 5) AS d_q, CASE WHEN e = 0 THEN 0 ELSE round((n_p - n_q) / e, 5) END AS pull, CASE WHEN e = 0 THEN 0 ELSE round((n_p / tp - n_q / tq) / e, 5) END AS pull_consistent FROM e""",
    "labelled_union": f"SELECT (side = 'F')::INT AS label, count(*) AS n, round(sum(px), 3) AS sum_px FROM {STATE_SQL} GROUP BY 1",
    "stratum_nll": f"SELECT round(sum(-w * log_p) / sum(w), 4) AS all, round(sum(-w * log_p) FILTER (id = 13) / sum(w) FILTER (id = 13), 4) AS rare, round(sum(-w * log_p) FILTER (id <> 13) / sum(w) FILTER (id <> 13), 4) AS main FROM {_SCORED}".replace("AS all", 'AS "all"'),
    "binomial_counts": "SELECT user_id, count_if(event_type = 'error')::BIGINT AS k, count(*) AS n, round(count_if(event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY user_id",
    "exact_duplicates": f"SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM (SELECT round(px, 6) AS px, round(py, 6) AS py, side FROM {STATE_SQL}) GROUP BY px, py, side)",
    "near_duplicates": f"""WITH e AS (SELECT event_id, value, event_id * 7919 % 5000 / 100 AS v, floor(value / {ATOL!r})::BIGINT AS c FROM events),
b AS (SELECT *, unnest([c - 1, c, c + 1]) AS k FROM e)
SELECT (SELECT count(*) FROM e) AS n_rows, (SELECT count(DISTINCT a.event_id) FROM e a JOIN b ON a.c = b.k AND a.event_id <> b.event_id AND (a.value - b.value) ** 2 + (a.v - b.v) ** 2 < {ATOL * ATOL!r}) AS n_near""",
    "out_of_support": f"WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE {_U5} < 0.1) SELECT count(*) AS n, count_if(value < lo OR value > hi)::BIGINT AS n_out, round(count_if(value < lo OR value > hi) / count(*), 9) AS rate FROM events, r WHERE {_U5} >= 0.1",
    "support_class": f"""WITH t AS (SELECT value FROM events WHERE {_U5} < 0.1), r AS (SELECT min(value) AS lo, max(value) AS hi FROM t), c AS (SELECT floor(value / 5)::BIGINT AS k, count(*) AS n FROM t GROUP BY 1)
SELECT CASE WHEN value < lo OR value > hi THEN 'extrapolation' WHEN coalesce(c.n, 0) < 20 THEN 'sparse' ELSE 'interpolation' END AS support, count(*) AS n FROM events CROSS JOIN r LEFT JOIN c ON c.k = floor(value / 5)::BIGINT WHERE {_U5} >= 0.1 GROUP BY 1""",
    "nn_spread": f"SELECT vec_id, round(distance, 5) AS distance FROM {_NEAREST}",
    "nn_summary": f"SELECT count(*) AS n, round(avg((distance = 0)::INT), 4) AS duplicate_rate, round(avg(distance), 4) AS mean_distance, round(min(distance), 4) AS min_distance FROM {_NEAREST_UNIT}",
}
_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
ORACLE_SQL["bootstrap_metric"] = f"WITH u AS (SELECT value, range::INT AS b, {sql.uniform('event_id', 1, 'range')} AS u FROM events, range(20)), c AS (SELECT b, value, {' + '.join(f'(u >= {c!r})::INT' for c in _CUTS)} AS c FROM u) SELECT b, round(sum(value * c) / sum(c), 5) AS mean FROM c GROUP BY b"

# The bundle's metrics, each from a select over the rows of its side.
_P, _Q = f"(SELECT * FROM {_WIDE} WHERE side = 'F')", f"(SELECT * FROM {_WIDE} WHERE side = 'O')"
_D = f"CASE WHEN {sql.ok('log_p - log_q')} THEN log_p - log_q END"
_POST = f"(SELECT w.*, exp(t[1] - list_max(t)) / list_sum(list_transform(t, lambda v: exp(v - list_max(t)))) AS post FROM (SELECT *, CASE WHEN id = 13 THEN [{', '.join(_terms(D2, 13))}] ELSE [{', '.join(_terms(D2, -13))}] END AS t FROM {_WIDE}) w)"
_SELECTS = {
    "held_out": (f"SELECT avg(CASE WHEN {sql.ok('log_q')} THEN -log_q END) AS nll, count_if(NOT {sql.ok('log_q')}) AS n_nonfinite, count(*) AS n FROM {_P}", ("nll", "n_nonfinite", "n")),
    "nonfinite": (f"SELECT count_if(NOT {sql.ok('log_q')}) / count(*) AS rate FROM {_P}", ("rate",)),
    "forward_kl": (f"SELECT avg({_D}) AS value, stddev_pop({_D}) / sqrt(count({_D})) AS std_error, count({_D}) AS n_finite, count(*) - count({_D}) AS n_nonfinite FROM {_P}", ("value", "std_error", "n_finite", "n_nonfinite")),
    "ess": (
        f"WITH l AS (SELECT (log_p - log_q) / 100 AS lw FROM {_Q}), f AS (SELECT lw, max(lw) OVER () AS top FROM l WHERE {sql.ok('lw')}) SELECT sum(exp(lw - top)) ** 2 / (count(*) * sum(exp(2 * (lw - top)))) AS ess_over_n, 1 / sum(exp(lw - top)) AS max_weight, min(lw) AS log_min, max(lw) AS log_max, max(lw) - min(lw) AS log_range, (SELECT count(*) FROM l) - count(*) AS n_excluded, (sum(exp(lw - top)) ** 2 / (count(*) * sum(exp(2 * (lw - top)))) < 0.01)::INT AS catastrophic FROM f",
        ("ess_over_n", "max_weight", "log_min", "log_max", "log_range", "n_excluded", "catastrophic"),
    ),
    "support": (f"SELECT count_if(NOT ({' AND '.join(map(sql.ok, P5))})) / count(*) AS nonfinite_rate, count_if(pz <= 0) / count(*) AS pz_rate, count_if(pz <= 0) AS n_pz FROM {_Q}", ("nonfinite_rate", "pz_rate", "n_pz")),
    "posterior": (f"SELECT avg(post) AS \"0\", avg(1 - post) AS \"1\" FROM {_POST} WHERE side = 'F'", ("0", "1")),
    "weight_ess": (f"SELECT sum(w) ** 2 / sum(w * w) AS value FROM {_P}", ("value",)),
    "duplicates": (f"SELECT sum(n) AS n_rows, count(*) AS n_distinct, sum(n) - count(*) AS n_duplicates FROM (SELECT count(*) AS n FROM {_Q} GROUP BY {', '.join(P5)})", ("n_rows", "n_distinct", "n_duplicates")),
    "near_duplicates": (
        f"WITH q AS (SELECT row_number() OVER () AS r, {', '.join(P5)}, floor(px)::BIGINT AS c FROM {_Q}), b AS (SELECT *, unnest([c - 1, c, c + 1]) AS k FROM q) SELECT count(DISTINCT a.r) AS n_near FROM q a JOIN b ON a.c = b.k AND a.r <> b.r AND {' + '.join(f'(a.{c} - b.{c}) ** 2' for c in P5)} < 0.25",
        ("n_near",),
    ),
    "rare": (
        f"SELECT *, n_inside / n AS mass, (n_inside = 0)::INT AS zero, n_inside / n / 0.01 AS mass_ratio, pow(0.99, n) AS p_zero FROM (SELECT count(*) AS n, count_if({_IN[13]}) AS n_inside FROM {_Q}), (SELECT avg(post) AS soft_mass FROM {_POST} WHERE side = 'O'), (SELECT avg(log_q) FILTER (id = 13 AND {sql.ok('log_q')}) AS log_q, avg({_D}) FILTER (id = 13) AS kl FROM {_P})",
        ("n_inside", "mass", "zero", "mass_ratio", "p_zero", "soft_mass", "log_q", "kl"),
    ),
} | {
    f"exceedance.{c}": (f"SELECT p, q, abs(p - q) AS abs_error FROM (SELECT avg(({c} > {t!r})::INT) AS p FROM {_P}), (SELECT avg(({c} > {t!r})::INT) AS q FROM {_Q})", ("p", "q", "abs_error")) for c, t in THRESHOLDS.items()
} | {
    f"tail.{c}.{level!r}": (f"SELECT p, q, abs(p - q) AS abs_error FROM (SELECT quantile_cont({c}, {level!r}) AS p FROM {_P}), (SELECT quantile_cont({c}, {level!r}) AS q FROM {_Q})", ("p", "q", "abs_error")) for c in P5 for level in (0.01, 0.99)
}
ORACLE_SQL["evaluate_bundle"] = " UNION ALL ".join(f"SELECT '{part}.{c}' AS metric, round(\"{c}\"::DOUBLE, 5) AS value FROM ({select})" for part, (select, names) in _SELECTS.items() for c in names)
