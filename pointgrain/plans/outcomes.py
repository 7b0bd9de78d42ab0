"""Queries on outcomes, labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointgrain.operators import outcomes as O
from pointgrain.plans.contracts import rounded
from pointgrain.sources.tables import table

_OUTCOME = "CASE WHEN event_type = 'error' THEN 'technical_failure' WHEN value < 50 THEN 'accepted' ELSE 'rejected' END"
_DIS = "CASE WHEN event_type <> 'error' THEN value < 20 WHEN event_id % 7 = 0 THEN true END"


def _outcomes(spark, sf_dir):
    """One outcome for each event, none for every 13th and two for every 17th."""
    one = table(spark, sf_dir, "events").selectExpr("event_id AS candidate_id", f"{_OUTCOME} AS outcome", f"{_DIS} AS dis", "value").where("candidate_id % 13 <> 0")
    return one.unionByName(one.where("candidate_id % 17 = 0"))


def outcome_violations(spark, sf_dir):
    return O.violations(_outcomes(spark, sf_dir)).select("candidate_id")


def label_filter(spark, sf_dir):
    return O.labelled(_outcomes(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def outcome_rates(spark, sf_dir):
    return rounded(O.outcome_rates(_outcomes(spark, sf_dir)), "accepted", "rejected")


def outcome_reconcile(spark, sf_dir):
    return O.reconcile(table(spark, sf_dir, "events").select(F.col("event_id").alias("candidate_id")), _outcomes(spark, sf_dir))


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.withColumn("score", F.col("n_chars") / (F.col("n_chars") + 1500))


def tail_fnr(spark, sf_dir):
    found = O.tail_fnr(_scored(spark, sf_dir), "score", F.col("quality") == 1, F.col("n_chars") > 3000, F.col("n_chars") < 30000, 0.7)
    return rounded(found, "recall", "fnr")


def calibration(spark, sf_dir):
    return rounded(O.calibration(O.checked_scores(_scored(spark, sf_dir), "score"), "score", F.col("quality") == 1), "predicted", "observed")


def score_weights(spark, sf_dir):
    """Total production and training weight of orders by status, the tilt being a price score."""
    orders = table(spark, sf_dir, "orders").withColumns({"w": F.lit(1.0), "s": F.col("o_totalprice") / (F.col("o_totalprice") + 1e5)})
    return O.score_weights(orders, "s").groupBy("o_orderstatus").agg(F.round(F.sum("w"), 3).alias("production"), F.round(F.sum("training_weight"), 3).alias("training"))


_ONE = f"SELECT event_id AS candidate_id, {_OUTCOME} AS outcome, {_DIS} AS dis, value FROM events WHERE event_id % 13 <> 0"
_ALL = f"({_ONE} UNION ALL {_ONE} AND event_id % 17 = 0)"
_SCORED = "(SELECT doc_id, n_chars, quality, n_chars / (n_chars + 1500) AS score FROM documents JOIN labels USING (doc_id))"

QUERIES = {f.__name__: f for f in (outcome_violations, label_filter, outcome_rates, outcome_reconcile, tail_fnr, calibration, score_weights)}
ORACLE_SQL = {
    "outcome_violations": f"SELECT candidate_id FROM {_ALL} WHERE outcome = 'technical_failure' AND dis IS NOT NULL",
    "label_filter": f"SELECT (outcome = 'accepted')::INT AS label, count(*) AS n, round(sum(value), 3) AS total FROM {_ALL} WHERE outcome <> 'technical_failure' GROUP BY 1",
    "outcome_rates": f"SELECT count(*) AS n, round(avg((outcome = 'accepted')::INT), 6) AS accepted, round(avg((outcome = 'rejected')::INT), 6) AS rejected FROM {_ALL} WHERE outcome <> 'technical_failure'",
    "outcome_reconcile": f"SELECT event_id AS candidate_id, 1::BIGINT AS n_proposals, coalesce(n, 0)::BIGINT AS n_outcomes FROM events LEFT JOIN (SELECT candidate_id, count(*) AS n FROM {_ALL} GROUP BY 1) ON candidate_id = event_id WHERE coalesce(n, 0) <> 1",
    "tail_fnr": f"SELECT count(*) AS n, round(avg((score >= 0.7)::INT), 6) AS recall, round(1 - avg((score >= 0.7)::INT), 6) AS fnr FROM {_SCORED} WHERE quality = 1 AND n_chars > 3000 AND n_chars < 30000",
    "calibration": f"SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg((quality = 1)::INT), 6) AS observed FROM {_SCORED} GROUP BY 1",
    "score_weights": "SELECT o_orderstatus, round(count(*)::DOUBLE, 3) AS production, round(sum(o_totalprice / (o_totalprice + 1e5)), 3) AS training FROM orders GROUP BY 1",
}
