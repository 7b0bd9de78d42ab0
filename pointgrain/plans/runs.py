"""Queries on run records. A run is an order: its metrics are arithmetic on the order's columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pointgrain.functions.canonical import json_text
from pointgrain.functions.expressions import finite
from pointgrain.operators import runs as R
from pointgrain.plans import sql
from pointgrain.plans.contracts import rounded
from pointgrain.sources.tables import _items, table

_D5 = "o_orderpriority LIKE '1%'"
#: Run records, in words that both engines read alike.
RUN_SELECT = f"""
  o_orderkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'completed' END AS technical,
  CASE WHEN {_D5} THEN 'D5' WHEN o_orderpriority LIKE '2%' THEN 'D4' WHEN o_orderpriority LIKE '3%' THEN 'D3' ELSE 'D0' END AS target,
  CASE WHEN {_D5} THEN (CASE WHEN o_custkey % 2 = 0 THEN 'rare_1e-2' ELSE 'rare_1e-3' END) END AS variant,
  CASE WHEN o_orderkey % 2 = 0 THEN 13 ELSE -13 END AS pdg_id,
  CASE WHEN o_custkey % 3 = 0 THEN 'identity' WHEN o_custkey % 3 = 1 THEN 'logpz' ELSE 'slope' END AS view,
  CASE WHEN o_orderkey % 3 = 0 THEN 'gauss' WHEN o_orderkey % 3 = 1 THEN 'mixture' ELSE 'flow' END AS model,
  CASE WHEN o_orderkey % 4 = 0 THEN 'gpu' ELSE 'cpu' END AS device, o_orderkey % 5 AS seed, 10 * (1 + o_custkey % 4) AS params,
  CASE WHEN o_orderkey % 29 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice % 1000e0 / 1000e0 END AS ess,
  CASE WHEN o_orderkey % 23 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice / 1e6 END AS kl,
  CASE WHEN o_orderkey % 37 = 0 THEN 1 WHEN o_orderkey % 41 = 0 THEN -1 WHEN o_orderkey % 43 = 0 THEN NULL ELSE 0 END AS kl_bad,
  CASE WHEN o_orderkey % 47 = 0 THEN 0.5e0 WHEN o_orderkey % 53 = 0 THEN 1.5e0 WHEN o_orderkey % 59 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 0e0 END AS rate,
  {_D5} AND o_orderkey % 13 <> 0 AS rare_present,
  CASE WHEN {_D5} THEN (CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 59 = 0 THEN -3 WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_custkey % 50 END) END AS rare_count
"""
RUN_SQL = f"(SELECT {RUN_SELECT} FROM orders)"
THRESHOLD = 0.01


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*_items(RUN_SELECT))


def _gates(df):
    return df.withColumns({
        "finiteness": R.gate_finiteness([F.col("kl")], [F.col("kl_bad")], [F.col("rate")]), "ess_floor": R.gate_ess(F.col("ess"), THRESHOLD),
        "zero_rare": R.gate_rare(F.col("target") == "D5", F.col("rare_present"), F.col("rare_count")),
    })


def _long(df):
    cells = [F.struct(F.lit(g).alias("gate"), F.col(g).alias("outcome")) for g in ("finiteness", "ess_floor", "zero_rare")]
    return _gates(df).select("run_id", F.explode(F.array(*cells)).alias("g")).select("run_id", "g.*")


def judged(spark, sf_dir):
    """Runs with a verdict; every 17th has none."""
    df = _gates(runs(spark, sf_dir))
    severity = F.greatest(*(F.coalesce(reduce(lambda w, kv: w.when(F.col(g) == kv[0], kv[1]), R.SEVERITY.items(), F.when(F.lit(False), 0)), F.lit(0)) for g in ("finiteness", "ess_floor", "zero_rare")))
    return df.withColumn("verdict", F.when(F.col("run_id") % 17 == 0, F.lit(None)).when(severity == 3, "catastrophic").when(severity == 1, "inconclusive").otherwise("pass"))


def _one(name):
    return lambda spark, sf_dir: _gates(runs(spark, sf_dir)).where(F.col(name).isNotNull()).select("run_id", F.col(name).alias("outcome"))


def gate_reported(spark, sf_dir):
    """Report-only values never change a verdict."""
    return runs(spark, sf_dir).where("technical = 'completed'").select("run_id", F.when(finite("kl"), F.round("kl", 6)).alias("kl"), R.number_class(F.col("kl")).alias("kl_class"), F.lit("report").alias("outcome"))


def gate_rollup(spark, sf_dir):
    return R.rollup(_long(runs(spark, sf_dir)))


def gate_threshold(spark, sf_dir):
    own = F.when(F.col("run_id") % 3 == 0, 0.05).when(F.col("run_id") % 7 == 0, 0.01)
    chosen = R.gate_threshold(own, F.when(F.col("run_id") % 2 == 0, F.lit(0.01)))
    return runs(spark, sf_dir).groupBy(chosen.alias("threshold")).agg(F.count("*").alias("n"))


def gate_summary(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("technical", "verdict").agg(F.count("*").alias("n"), F.count_if((F.col("rare_count") == 0) & F.col("rare_present")).alias("n_zero_rare"))


def gate_lists(spark, sf_dir, most: int = 20):
    """The gate summary as rows (what, value): counts, scopes, and lists of run ids, with the number that overflows."""
    scoped = judged(spark, sf_dir).withColumn("scope", F.when(F.col("run_id") % 3 == 0, "pilot").when(F.col("run_id") % 3 == 1, "full"))
    one, rest = R.gate_summary(scoped, most=most)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    cells = {"n_runs": F.col("n_runs").cast("string"), "decision_scope": text("decision_scope")}
    counts = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat_ws(":", k, F.element_at(m, k).cast("string"))), ",")
    cells |= {c: counts(F.col(c)) for c in ("technical_counts", "verdict_counts")}
    for n in R.LISTS:
        cells |= {f"n_{n}": F.col(f"n_{n}").cast("string"), f"{n}_runs": text(f"{n}_runs")}
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), c.alias("value")) for n, c in cells.items()))).alias("r")).select("r.*")
    return rows.unionByName(rest.groupBy(F.concat(F.lit("overflow_"), "kind").alias("what")).agg(F.count("*").cast("string").alias("value")))


def run_key_nested(spark, sf_dir):
    """Run keys from nested configurations in canonical form."""
    f = F.struct(F.array("seed", "params").alias("sizes"), F.col("view").alias("id"), (F.col("seed") / 4).alias("rate"))
    config = F.struct(F.col("seed"), F.create_map(F.col("model"), F.lit(True), F.lit("a b"), F.lit(None)).alias("options"), f.alias("feature_view"), F.col("variant"))
    df = runs(spark, sf_dir).select("run_id", "target", config.alias("config"))
    return df.select("run_id", R.run_key([F.col("target")], json_text(F.col("config"), df.schema["config"].dataType)).alias("run_key"))


def run_assembly(spark, sf_dir):
    df = runs(spark, sf_dir)
    status, config = df.select("run_id", "technical"), df.where("run_id % 19 <> 0").select("run_id", "target", "model", "seed")
    metrics = df.where("technical = 'completed' AND run_id % 23 <> 0").select("run_id", "kl", "kl_bad")
    return rounded(R.assemble(status, config, metrics), "kl")


GROUP = ("target", "variant", "pdg_id", "view", "model", "device")


def run_summary(spark, sf_dir):
    out = R.run_summary(judged(spark, sf_dir), GROUP, ["ess", "kl"])
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


def run_counts(spark, sf_dir):
    return R.run_counts(judged(spark, sf_dir))


def series_stats(spark, sf_dir):
    return rounded(R.series_stats(runs(spark, sf_dir), ["target", "variant", "device"], "ess"), "mean", "std")


def capacity_curve(spark, sf_dir):
    return rounded(R.series_stats(runs(spark, sf_dir), ["target", "device", "params"], "ess"), "mean", "std")


def metrics_unpivot(spark, sf_dir):
    nested = runs(spark, sf_dir).select("run_id", F.struct(F.struct("kl", "kl_bad").alias("forward"), "ess", "rare_present", F.col("view").alias("label")).alias("m"))
    return rounded(R.long_numbers(nested, "run_id", ["m.forward.kl", "m.forward.kl_bad", "m.ess", "m.rare_present", "m.label"]), "value")


def params_unpivot(spark, sf_dir):
    return R.long_strings(runs(spark, sf_dir), "run_id", ["target", "variant", "pdg_id", "view", "seed"])


def run_key(spark, sf_dir):
    config = F.concat(F.lit('{"model":"'), "model", F.lit('","seed":'), F.col("seed").cast("string"), F.lit("}"))
    return runs(spark, sf_dir).select("run_id", R.run_key([F.col("target"), F.concat_ws(" ", "view", "model"), F.col("seed")], config).alias("run_key"))


def series_label(spark, sf_dir):
    df = runs(spark, sf_dir).select(R.series_label(F.col("target"), F.col("variant")).alias("series"), R.series_order(F.col("target")).alias("order"))
    return df.groupBy("series", "order").agg(F.count("*").alias("n")).orderBy("order", "series")


def best_epoch(spark, sf_dir):
    """Each user's events as a training history."""
    return R.best_epoch(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 10)


def _stored(spark, sf_dir):
    df = judged(spark, sf_dir)
    code = F.when(F.col("run_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("h"), (F.col("run_id") % 7).cast("string")))
    return df.where("run_id % 3 <> 0").select("run_id", "technical", code.alias("config_hash"), F.when(F.col("run_id") % 17 == 1, "odd").otherwise(F.col("verdict")).alias("verdict"))


def _planned(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", F.concat(F.lit("h"), F.when(F.col("run_id") % 13 == 0, F.lit(9)).otherwise(F.col("run_id") % 7).cast("string")).alias("config_hash"))


def resume_pending(spark, sf_dir):
    return R.resume_pending(_planned(spark, sf_dir), _stored(spark, sf_dir))


def resume_verdict(spark, sf_dir):
    return R.resume_verdict(_planned(spark, sf_dir).select("run_id"), _stored(spark, sf_dir))


KEYS = ("target", "variant", "pdg_id", "model", "device", "seed", "params")


def _arms(spark, sf_dir):
    return runs(spark, sf_dir).where(finite("ess")).groupBy(*KEYS, "view").agg(F.max("ess").alias("ess"))


def matched_arms(spark, sf_dir):
    return rounded(R.matched_arms(_arms(spark, sf_dir), KEYS, "view", "identity", "ess"), "baseline", "candidate", "gain")


AXES = ("target", "pdg_id", "view", "model", "seed")


def grid_gaps(spark, sf_dir):
    df = runs(spark, sf_dir)
    return R.grid_gaps(R.grid(df, AXES), df.where("kl_bad = 0 AND ess > 0.8"), AXES)


def grid_invalid(spark, sf_dir):
    """Grid cells that ask for a stratified draw of a target without a rare component."""
    df = runs(spark, sf_dir)
    cells = R.grid(df, ["target", "model"]).withColumn("sampling", F.explode(F.array(F.lit("nominal"), F.lit("stratified"))))
    valid = df.where("rare_present").select("target", F.lit("stratified").alias("sampling")).unionByName(df.select("target", F.lit("nominal").alias("sampling")))
    return R.grid_invalid(cells, valid, ["target", "sampling"])


def run_select(spark, sf_dir, targets=("D4", "D5"), models=None, seeds=(0, 1)):
    """Runs by sets of targets, models and seeds; None takes all."""
    return R.select_runs(runs(spark, sf_dir), target=targets, model=models, seed=seeds).select("run_id", "target", "model", "seed")


def _passing(spark, sf_dir):
    df = judged(spark, sf_dir).where("technical = 'completed'")
    return df.groupBy("target", "view", "model", "params", "seed").agg(F.max(F.when(F.col("verdict") == "pass", F.col("ess"))).alias("ess"))


def promotion(spark, sf_dir, least: int = 4, benefit: float = 0.01):
    """Candidate views that pass for enough seeds and beat the identity view's mean by the benefit."""
    return rounded(R.promotion(_passing(spark, sf_dir), ["target", "model"], "view", "identity", "seed", "ess", least, benefit), "gain")


def min_sufficient(spark, sf_dir, least: int = 4):
    """Cheapest model size that passes for enough seeds, for each target and view."""
    return R.min_sufficient(_passing(spark, sf_dir), ["target", "view"], "params", "model", "seed", F.col("ess") > 0.5, least)


_SEV = "CASE {g} WHEN 'catastrophic' THEN 3 WHEN 'fail' THEN 2 WHEN 'inconclusive' THEN 1 ELSE 0 END"
_OK = sql.ok
_FIN = f"CASE WHEN (kl IS NOT NULL AND NOT {_OK('kl')}) OR coalesce(kl_bad > 0, false) OR (rate > 0 AND rate <= 1) THEN 'catastrophic' WHEN kl IS NULL OR kl_bad IS NULL OR kl_bad < 0 OR NOT isfinite(rate) OR rate > 1 THEN 'inconclusive' ELSE 'pass' END"
_ESS = f"CASE WHEN ess IS NULL THEN 'inconclusive' WHEN NOT {_OK('ess')} OR ess < 0.01 THEN 'catastrophic' ELSE 'pass' END"
_RARE = "CASE WHEN target <> 'D5' THEN NULL WHEN NOT rare_present OR rare_count IS NULL OR rare_count <= 0 THEN 'inconclusive' ELSE 'pass' END"
_GATED = f"(SELECT *, {_FIN} AS finiteness, {_ESS} AS ess_floor, {_RARE} AS zero_rare FROM {RUN_SQL})"
_TOP = "greatest(" + ", ".join(_SEV.format(g=g) for g in ("finiteness", "ess_floor", "zero_rare")) + ")"
_NAME = "CASE {t} WHEN 3 THEN 'catastrophic' WHEN 2 THEN 'fail' WHEN 1 THEN 'inconclusive' ELSE 'pass' END"
_JUDGED = f"(SELECT *, CASE WHEN run_id % 17 <> 0 THEN {_NAME.format(t=_TOP)} END AS verdict FROM {_GATED})"
_PASS = f"(SELECT target, view, model, params, seed, max(CASE WHEN verdict = 'pass' THEN ess END) AS ess FROM {_JUDGED} WHERE technical = 'completed' GROUP BY ALL)"
_CLEAN = "(verdict IS DISTINCT FROM 'catastrophic') AND {ok}"


def _mean(m):
    ok = _CLEAN.format(ok=_OK(m))
    return f"round(avg({m}) FILTER ({ok}), 6) AS {m}_mean, round(coalesce(stddev_pop({m}) FILTER ({ok}), 0), 6) AS {m}_std"


def _series(group):
    return f"SELECT {group}, round(avg(ess) FILTER ({_OK('ess')}), 6) AS mean, round(coalesce(stddev_pop(ess) FILTER ({_OK('ess')}), 0), 6) AS std, count(*) FILTER ({_OK('ess')}) AS n FROM {RUN_SQL} WHERE technical = 'completed' GROUP BY ALL"


_STORED = f"(SELECT run_id, technical, CASE WHEN run_id % 5 <> 0 THEN 'h' || (run_id % 7) END AS config_hash, CASE WHEN run_id % 17 = 1 THEN 'odd' ELSE verdict END AS verdict FROM {_JUDGED} WHERE run_id % 3 <> 0)"
_PLANNED = f"(SELECT run_id, 'h' || CASE WHEN run_id % 13 = 0 THEN 9 ELSE run_id % 7 END AS config_hash FROM {RUN_SQL})"
_ARMS = f"(SELECT {', '.join(KEYS)}, view, max(ess) AS ess FROM {RUN_SQL} WHERE {_OK('ess')} GROUP BY ALL)"
_LONG = {"m.forward.kl": "kl", "m.forward.kl_bad": "kl_bad", "m.ess": "ess", "m.rare_present": "rare_present::INT"}

QUERIES = {"gate_finiteness": _one("finiteness"), "gate_ess": _one("ess_floor"), "gate_rare": _one("zero_rare")} | {
    f.__name__: f
    for f in (gate_reported, gate_rollup, gate_threshold, gate_summary, run_assembly, run_summary, run_counts, series_stats, capacity_curve, metrics_unpivot, params_unpivot, run_key, series_label, best_epoch, resume_pending, resume_verdict, matched_arms, grid_gaps, grid_invalid, run_select, promotion, min_sufficient, gate_lists, run_key_nested)
}
ORACLE_SQL = {
    "gate_finiteness": f"SELECT run_id, finiteness AS outcome FROM {_GATED}",
    "gate_ess": f"SELECT run_id, ess_floor AS outcome FROM {_GATED}",
    "gate_rare": f"SELECT run_id, zero_rare AS outcome FROM {_GATED} WHERE zero_rare IS NOT NULL",
    "gate_reported": f"SELECT run_id, CASE WHEN {_OK('kl')} THEN round(kl, 6) END AS kl, CASE WHEN {_OK('kl')} THEN 'finite' ELSE 'nonfinite' END AS kl_class, 'report' AS outcome FROM {RUN_SQL} WHERE technical = 'completed'",
    "gate_rollup": f"SELECT run_id, {_NAME.format(t=_TOP)} AS verdict, concat_ws(',', " + ", ".join(f"CASE WHEN {_SEV.format(g=g)} > 0 THEN '{g}' END" for g in ("ess_floor", "finiteness", "zero_rare")) + f") AS reasons FROM {_GATED}",
    "gate_threshold": "WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0.05e0 WHEN o_orderkey % 7 = 0 THEN 0.01e0 END AS g, CASE WHEN o_orderkey % 2 = 0 THEN 0.01e0 END AS e FROM orders) SELECT CASE WHEN g <> e THEN NULL ELSE coalesce(g, e) END AS threshold, count(*) AS n FROM t GROUP BY 1",
    "gate_summary": f"SELECT technical, verdict, count(*) AS n, count_if(rare_count = 0 AND rare_present)::BIGINT AS n_zero_rare FROM {_JUDGED} GROUP BY ALL",
    "run_assembly": f"WITH r AS {RUN_SQL} SELECT s.run_id, s.technical, c.target, c.model, c.seed, round(m.kl, 6) AS kl, m.kl_bad FROM r s LEFT JOIN (FROM r WHERE run_id % 19 <> 0) c USING (run_id) LEFT JOIN (FROM r WHERE technical = 'completed' AND run_id % 23 <> 0) m USING (run_id)",
    "run_summary": f"SELECT {', '.join(GROUP)}, count(*) AS n, count_if(verdict IS NULL)::BIGINT AS n_unknown, {', '.join(f'count_if(verdict = {v!r})::BIGINT AS n_{v}' for v in R.VERDICTS)}, {_mean('ess')}, {_mean('kl')} FROM {_JUDGED} WHERE technical = 'completed' GROUP BY ALL",
    "run_counts": f"SELECT count(*) AS n, count_if(technical = 'completed')::BIGINT AS n_completed, count_if(technical = 'failed')::BIGINT AS n_failed, {', '.join(f'count_if(verdict = {v!r})::BIGINT AS n_{v}' for v in R.VERDICTS)} FROM {_JUDGED}",
    "series_stats": _series("target, variant, device"),
    "capacity_curve": _series("target, device, params"),
    "metrics_unpivot": " UNION ALL ".join(f"SELECT run_id, '{n}' AS name, round({e}::DOUBLE, 6) AS value FROM {RUN_SQL} WHERE {_OK(f'({e})::DOUBLE')}" for n, e in _LONG.items()),
    "params_unpivot": " UNION ALL ".join(f"SELECT run_id, '{c}' AS name, {c}::VARCHAR AS value FROM {RUN_SQL} WHERE {c} IS NOT NULL" for c in ("target", "variant", "pdg_id", "view", "seed")),
    "run_key": f"""SELECT run_id, concat_ws('__', target, view || '-' || model, seed, substr(sha256('{{"model":"' || model || '","seed":' || seed || '}}'), 1, 12)) AS run_key FROM {RUN_SQL}""",
    "series_label": f"SELECT CASE WHEN variant IS NULL OR target <> 'D5' THEN target ELSE target || '-' || substr(variant, 6) END AS series, CASE target WHEN 'D0' THEN 0 WHEN 'D3' THEN 3 WHEN 'D4' THEN 4 WHEN 'D5' THEN 5 END AS \"order\", count(*) AS n FROM {RUN_SQL} GROUP BY ALL",
    "best_epoch": """WITH h AS (SELECT user_id, event_id, value, row_number() OVER w AS i, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT *, low IS NULL OR value < low - 1e-9 AS better FROM h), l AS (SELECT *, max(CASE WHEN better THEN i END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM m),
s AS (SELECT user_id, min(CASE WHEN i - last >= 10 THEN event_id END) AS stop_epoch FROM l GROUP BY user_id)
SELECT user_id, max(CASE WHEN better THEN event_id END)::BIGINT AS best_epoch, min(value) AS best_loss, any_value(stop_epoch) AS stop_epoch FROM l JOIN s USING (user_id) WHERE stop_epoch IS NULL OR event_id <= stop_epoch GROUP BY user_id""",
    "resume_pending": f"SELECT p.run_id, p.config_hash FROM {_PLANNED} p WHERE NOT EXISTS (SELECT 1 FROM {_STORED} s WHERE s.technical = 'completed' AND s.run_id = p.run_id AND (s.config_hash IS NULL OR s.config_hash = p.config_hash))",
    "resume_verdict": f"SELECT p.run_id, CASE WHEN s.run_id IS NULL THEN NULL WHEN s.verdict IN ('catastrophic', 'fail', 'inconclusive', 'pass') THEN s.verdict ELSE 'unavailable' END AS verdict FROM {_PLANNED} p LEFT JOIN {_STORED} s USING (run_id)",
    "matched_arms": f"SELECT {', '.join(f'c.{k}' for k in KEYS)}, c.view, round(b.ess, 6) AS baseline, round(c.ess, 6) AS candidate, round(c.ess - b.ess, 6) AS gain FROM {_ARMS} c JOIN {_ARMS} b ON b.view = 'identity' AND c.view <> 'identity' AND " + " AND ".join(f"c.{k} IS NOT DISTINCT FROM b.{k}" for k in KEYS),
    "grid_gaps": f"WITH r AS {RUN_SQL} SELECT * FROM " + ", ".join(f"(SELECT DISTINCT {a} FROM r)" for a in AXES) + f" EXCEPT SELECT {', '.join(AXES)} FROM r WHERE kl_bad = 0 AND ess > 0.8",
    "grid_invalid": f"WITH r AS {RUN_SQL} SELECT target, model, 'stratified' AS sampling FROM (SELECT DISTINCT target FROM r), (SELECT DISTINCT model FROM r) WHERE target NOT IN (SELECT target FROM r WHERE rare_present)",
    "run_select": f"SELECT run_id, target, model, seed FROM {RUN_SQL} WHERE target IN ('D4', 'D5') AND seed IN (0, 1)",
    "promotion": f"WITH a AS (SELECT target, model, view, count(DISTINCT seed) FILTER (ess IS NOT NULL) AS n_pass, avg(ess) AS ess FROM {_PASS} GROUP BY ALL) SELECT c.target, c.model, c.view, c.n_pass, round(c.ess - b.ess, 6) AS gain, c.n_pass >= 4 AND c.ess - b.ess >= 0.01 AS promoted FROM a c JOIN a b ON b.view = 'identity' AND c.view <> 'identity' AND b.target = c.target AND b.model = c.model",
    "min_sufficient": f"WITH a AS (SELECT target, view, model, params, count(DISTINCT seed) FILTER (ess > 0.5) AS n FROM {_PASS} GROUP BY ALL) SELECT target, view, min(params) AS params, arg_min(model, (params, model)) AS model FROM a WHERE n >= 4 GROUP BY ALL",
    "gate_lists": f"""WITH j AS (SELECT *, CASE run_id % 3 WHEN 0 THEN 'pilot' WHEN 1 THEN 'full' END AS scope FROM {_JUDGED}),
k AS (SELECT 'catastrophic' AS kind, run_id FROM j WHERE verdict = 'catastrophic' UNION ALL SELECT 'inconclusive', run_id FROM j WHERE verdict = 'inconclusive' UNION ALL SELECT 'zero_rare', run_id FROM j WHERE target = 'D5' AND rare_count = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY run_id) AS no FROM k), l AS (SELECT unnest(['catastrophic', 'inconclusive', 'zero_rare']) AS kind)
SELECT 'n_runs' AS what, count(*)::VARCHAR AS value FROM j UNION ALL SELECT 'decision_scope', string_agg(DISTINCT scope, ',' ORDER BY scope) FROM j
UNION ALL SELECT 'technical_counts', string_agg(technical || ':' || n, ',' ORDER BY technical) FROM (SELECT technical, count(*) AS n FROM j GROUP BY 1) UNION ALL SELECT 'verdict_counts', string_agg(verdict || ':' || n, ',' ORDER BY verdict) FROM (SELECT verdict, count(*) AS n FROM j WHERE verdict IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'n_' || kind, count(run_id)::VARCHAR FROM l LEFT JOIN k USING (kind) GROUP BY kind UNION ALL SELECT kind || '_runs', coalesce(string_agg(run_id, ',' ORDER BY run_id), '') FROM l LEFT JOIN (FROM o WHERE no <= 20) USING (kind) GROUP BY kind
UNION ALL SELECT 'overflow_' || kind, count(*)::VARCHAR FROM o WHERE no > 20 GROUP BY kind""",
    "run_key_nested": f"""SELECT run_id, target || '__' || substr(sha256('{{"feature_view":{{"id":"' || view || '","rate":' || (seed / 4)::VARCHAR || ',"sizes":[' || seed || ',' || params || ']}},"options":{{"a b":null,"' || model || '":true}},"seed":' || seed || ',"variant":' || coalesce('"' || variant || '"', 'null') || '}}'), 1, 12) AS run_key FROM {RUN_SQL}""",
}
