"""Queries on splits, subsets, generators and selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pointgrain.functions import targets as T
from pointgrain.operators import sampling
from pointgrain.plans import sql
from pointgrain.plans.contracts import rounded
from pointgrain.plans.views import _S
from pointgrain.sources.tables import STATE_SQL, state_view, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def hash_split(spark, sf_dir):
    return sampling.hash_split(_events(spark, sf_dir), "event_id", 0.2, 11).select("event_id", "part")


def exact_split(spark, sf_dir):
    return sampling.exact_split(_events(spark, sf_dir), "event_id", 0.2, 11).select("event_id", "part")


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_events(spark, sf_dir), "event_id", "event_type", 0.2, 11).select("event_id", "event_type", "part")


def group_split(spark, sf_dir):
    return sampling.group_split(_events(spark, sf_dir), "user_id", 0.2, 11).select("event_id", "user_id", "part")


def split_take(spark, sf_dir):
    """Rows of the train split taken by its key list."""
    events = _events(spark, sf_dir)
    keys = sampling.hash_split(events, "event_id", 0.2, 11).where("part = 'train'")
    return sampling.take(events, keys, "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def range_anchors(spark, sf_dir):
    return sampling.range_anchors(_events(spark, sf_dir).withColumn("user", F.col("user_id").cast("double")), ["value", "user"], "event_id")


def anchor_pool(spark, sf_dir):
    events = _events(spark, sf_dir)
    return sampling.leave(events, sampling.range_anchors(events, ["value"], "event_id"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


def representative_subset(spark, sf_dir):
    return sampling.representative_subset(_events(spark, sf_dir), ["value"], "event_id", 200, 11)


def head_n(spark, sf_dir):
    return sampling.head_n(_events(spark, sf_dir), "event_id", 100, 12)


def tail_mask(spark, sf_dir):
    """Test events above the 0.95 quantile of the train events."""
    parts = sampling.hash_split(_events(spark, sf_dir), "event_id", 0.2, 11)
    return sampling.tail_mask(parts.where("part = 'train'"), parts.where("part = 'validation'"), "value", 0.95).select("event_id", "tail")


def weighted_resample(spark, sf_dir):
    return sampling.weighted_resample(_events(spark, sf_dir), "value", "event_id", 150, 13).select("event_id")


def weight_normalize(spark, sf_dir):
    """Weights that sum to 1 within each id."""
    shares = sampling.weight_shares(state_view(spark, sf_dir).select("id", "px", "w"), "w", "id")
    return shares.select("id", F.round("px", 6).alias("px"), F.round(F.col("share") * 1e6, 6).alias("share"))


def rank_transform(spark, sf_dir):
    """Ranks of the values by rows of equal value, and their normal scores."""
    return sampling.rank_transform(_events(spark, sf_dir), "value").select("value", "n", F.round("rank", 9).alias("rank"), F.round("score", 4).alias("score"))


LEVELS = (10.0, 20.0, 50.0, 100.0, 200.0)


def snap_levels(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(sampling.snap(F.col("value"), LEVELS).alias("level")).agg(F.count("*").alias("n"))


def component_labels(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 400).alias("n_rare"))


# Generators: a row for each event, keyed by event_id.


def _n(spark, sf_dir):
    return table(spark, sf_dir, "events").count()


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))


def _generated(name, variant="rare_1e-2", rare=False):
    def query(spark, sf_dir):
        rows = sampling.generate(_keys(spark, sf_dir), T.target(name, variant), 13, 42, _n(spark, sf_dir) // 10 if rare else None)
        return rounded(rows.select("row_id", *T.COLUMNS, "component_id"), *T.COLUMNS, digits=5)

    return query


def stratum_weights(spark, sf_dir):
    rows = sampling.generate(_keys(spark, sf_dir), T.target("D5"), 13, 42, _n(spark, sf_dir) // 10)
    weighted = sampling.stratum_weights(rows, F.col("component_id") == 3, 0.01, 0.1)
    return weighted.groupBy("component_id").agg(F.count("*").alias("n"), F.round(F.sum("sample_weight"), 4).alias("weight"))


def partition_build(spark, sf_dir):
    n = _n(spark, sf_dir)
    rows = sampling.build_partitions(_keys(spark, sf_dir), T.target("D2"), -13, {"train": n, "validation": n // 2, "test_nominal": n // 2}, 42)
    return rows.groupBy("partition", "component_id").agg(F.count("*").alias("n"), F.round(F.sum("px"), 3).alias("sum_px"))


# Selection by score.


def _scores(spark, sf_dir):
    return _events(spark, sf_dir).withColumns({"score": F.col("value") / (F.col("value") + 50), "cell": F.floor(F.col("value") / 25).cast("long")})


def acq_random(spark, sf_dir):
    return sampling.acquire_random(_events(spark, sf_dir), "event_id", 50, 21).select("event_id")


def acq_topk(spark, sf_dir):
    return sampling.acquire_top(_scores(spark, sf_dir), "score", "event_id", 50).select("event_id", F.round("score", 9).alias("score"))


def acq_diverse(spark, sf_dir):
    """Top 50 with at most 5 of a cell."""
    return sampling.acquire_diverse(_scores(spark, sf_dir), "score", "event_id", "cell", 50, 5).select("event_id", "cell")


_P = f"CASE WHEN {sql.uniform('event_id', 11)} < 0.2 THEN 'validation' ELSE 'train' END"
_C = sql.code


def _gen_sql(t, seed, n, n_rare=None, pdg_id=13, forward=True):
    """The same draws in SQL: hashed uniforms, Box-Muller, Cholesky rows and the transform."""
    comps = t.components[pdg_id]
    main = [0.0 if n_rare is not None and k == t.rare[pdg_id] else c.weight for k, c in enumerate(comps)]
    ends = np.cumsum(main) / sum(main)
    live = [k for k, w in enumerate(main) if w]
    u = sql.uniform("row_id", seed, "'component'")
    comp = "CASE " + (f"WHEN row_id < {n_rare} THEN {t.rare[pdg_id]} " if n_rare is not None else "") + " ".join(f"WHEN {u} < {float(ends[k])!r} THEN {k}" for k in live) + f" ELSE {live[-1]} END"
    draws = ", ".join(f"{sql.normal('row_id', seed, k)} AS e{k}" for k in range(5))
    cells = {}
    for i, c in enumerate(T.COLUMNS):
        lows = [np.linalg.cholesky(np.asarray(x.cov)) for x in comps]
        cells[c] = "CASE component_id " + " ".join(f"WHEN {k} THEN {x.mean[i]!r} + " + " + ".join(f"e{j} * ({float(lows[k][i, j])!r})" for j in range(i + 1)) for k, x in enumerate(comps)) + " END"
    base = f"(SELECT row_id, component_id, {', '.join(f'{e} AS {c}' for c, e in cells.items())} FROM (SELECT row_id, {comp} AS component_id, {draws} FROM (SELECT range AS row_id FROM range({n}))))"
    if t.scales:
        base = f"(SELECT row_id, component_id, {', '.join(c if not b else f'{a!r} * sinh({b!r} + asinh({c} / {a!r})) AS {c}' for c, (a, b) in _S.items())} FROM {base})"
    if t.banana:
        p = t.banana
        u = f"(px / {p['scale_px']!r})"
        base = f"(SELECT row_id, component_id, px, py + {p['curvature'] * p['scale_py']!r} * {u} * {u} AS py, pz, x + {p['shear'] * p['scale_x']!r} * {u} AS x, y FROM {base})"
    return base


_N = "(SELECT count(*) FROM events)"


def _gen_out(t, n_rare=None):
    return f"SELECT row_id, {', '.join(f'round({c}, 5) AS {c}' for c in T.COLUMNS)}, component_id FROM {_gen_sql(t, 42, _N, n_rare)}"


_TENTH = f"({_N} // 10)"
_PART = [("train", 0, _N), ("validation", 1, f"({_N} // 2)"), ("test_nominal", 2, f"({_N} // 2)")]
QUERIES = {f.__name__: f for f in (hash_split, exact_split, stratified_split, group_split, split_take, range_anchors, anchor_pool, representative_subset, head_n, tail_mask, weighted_resample, weight_normalize, rank_transform, snap_levels, component_labels, stratum_weights, partition_build, acq_random, acq_topk, acq_diverse)} | {
    "generate_gaussian": _generated("D1"), "generate_mixture": _generated("D2"), "generate_transformed": _generated("D4"), "generate_stratified": _generated("D5", rare=True),
}
_BEST = "CASE WHEN p < 0.5 THEN -1 ELSE 1 END * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))"
ORACLE_SQL = {
    "hash_split": f"SELECT event_id, {_P} AS part FROM events",
    "exact_split": f"SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {_C('event_id', 11)}, event_id) <= round_even(count(*) OVER () * 0.2, 0) THEN 'validation' ELSE 'train' END AS part FROM events",
    "stratified_split": f"SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY {_C('event_id', 11)}, event_id) <= greatest(round(count(*) OVER (PARTITION BY event_type) * 0.2e0), 1) THEN 'validation' ELSE 'train' END AS part FROM events",
    "group_split": f"SELECT event_id, user_id, {_P.replace('event_id', 'user_id')} AS part FROM events",
    "split_take": f"SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE {_P} = 'train' GROUP BY event_type",
    "range_anchors": "SELECT DISTINCT unnest([arg_min(event_id, (value, event_id)), arg_max(event_id, (value, -event_id)), arg_min(event_id, (user_id, event_id)), arg_max(event_id, (user_id, -event_id))]) AS event_id FROM events",
    "anchor_pool": "SELECT event_type, count(*) AS n FROM events WHERE event_id NOT IN (SELECT unnest([arg_min(event_id, (value, event_id)), arg_max(event_id, (value, -event_id))]) FROM events) GROUP BY event_type",
    "representative_subset": f"""WITH a AS (SELECT DISTINCT unnest([arg_min(event_id, (value, event_id)), arg_max(event_id, (value, -event_id))]) AS k FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY event_id IN (FROM a) DESC, {_C('event_id', 11)}, event_id) AS r FROM events) SELECT event_id, user_id, event_type, value FROM r WHERE r <= 200""",
    "head_n": f"SELECT event_id, user_id, event_type, value FROM events ORDER BY {_C('event_id', 12)}, event_id LIMIT 100",
    "tail_mask": f"SELECT event_id, value > (SELECT quantile_cont(value, 0.95) FROM events WHERE {_P} = 'train') AS tail FROM events WHERE {_P} = 'validation'",
    "weighted_resample": f"SELECT event_id FROM events WHERE value > 0 ORDER BY -ln({sql.uniform('event_id', 13)}) / value, event_id LIMIT 150",
    "weight_normalize": f"SELECT id, round(px, 6) AS px, round(w / sum(w) OVER (PARTITION BY id) * 1e6, 6) AS share FROM {STATE_SQL}",
    "rank_transform": f"WITH r AS (SELECT value, n, (sum(n) OVER (ORDER BY value) - n) / (sum(n) OVER () - 1) AS rank, sum(n) OVER () AS total FROM (SELECT value, count(*) AS n FROM events GROUP BY value)), p AS (SELECT *, (rank * total + 0.5) / (total + 1) AS p FROM r), t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p) SELECT value, n, round(rank, 9) AS rank, round({_BEST}, 4) AS score FROM t",
    "snap_levels": f"SELECT [{', '.join(map(repr, LEVELS))}][list_position(d, list_min(d))]::DOUBLE AS level, count(*) AS n FROM (SELECT list_transform([{', '.join(map(repr, LEVELS))}], lambda v: abs(v - value)) AS d FROM events) GROUP BY 1",
    "component_labels": "SELECT event_type, count(*) AS n, count_if(value > 400)::BIGINT AS n_rare FROM events GROUP BY event_type",
    "generate_gaussian": _gen_out(T.target("D1")),
    "generate_mixture": _gen_out(T.target("D2")),
    "generate_transformed": _gen_out(T.target("D4")),
    "generate_stratified": _gen_out(T.target("D5"), _TENTH),
    "stratum_weights": f"SELECT component_id, count(*) AS n, round(sum(CASE WHEN component_id = 3 THEN 0.01 / 0.1 ELSE 0.99 / 0.9 END), 4) AS weight FROM {_gen_sql(T.target('D5'), 42, _N, _TENTH)} GROUP BY component_id",
    "partition_build": " UNION ALL ".join(f"SELECT '{p}' AS partition, component_id, count(*) AS n, round(sum(px), 3) AS sum_px FROM {_gen_sql(T.target('D2'), 42000 + i, n, None, -13)} GROUP BY component_id" for p, i, n in _PART),
    "acq_random": f"SELECT event_id FROM events ORDER BY {_C('event_id', 21)}, event_id LIMIT 50",
    "acq_topk": "SELECT event_id, round(value / (value + 50), 9) AS score FROM events ORDER BY value DESC, event_id LIMIT 50",
    "acq_diverse": "SELECT event_id, cell FROM (SELECT event_id, value, floor(value / 25)::BIGINT AS cell FROM events QUALIFY row_number() OVER (PARTITION BY floor(value / 25) ORDER BY value DESC, event_id) <= 5) ORDER BY value DESC, event_id LIMIT 50",
}
