"""Proposals, outcomes, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What can become of a candidate.
FAILURE, ACCEPTED, REJECTED = "technical_failure", "accepted", "rejected"


def violations(outcomes: DataFrame) -> DataFrame:
    """Outcomes that break the rule that a technical failure tells nothing about the physics."""
    return outcomes.where((F.col("outcome") == FAILURE) & F.col("dis").isNotNull())


def labelled(outcomes: DataFrame) -> DataFrame:
    """Trustworthy outcomes with a training label: 1 for accepted."""
    return outcomes.where(F.col("outcome") != FAILURE).withColumn("label", F.when(F.col("outcome") == ACCEPTED, 1).otherwise(0))


def outcome_rates(outcomes: DataFrame) -> DataFrame:
    sure = outcomes.where(F.col("outcome") != FAILURE)
    return sure.agg(F.count("*").alias("n"), F.avg((F.col("outcome") == ACCEPTED).cast("double")).alias("accepted"), F.avg((F.col("outcome") == REJECTED).cast("double")).alias("rejected"))


def reconcile(proposals: DataFrame, outcomes: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates without exactly one outcome, and outcomes without a proposal."""
    a = proposals.groupBy(key).agg(F.count("*").alias("n_proposals"))
    b = outcomes.groupBy(key).agg(F.count("*").alias("n_outcomes"))
    return a.join(b, key, "full").fillna(0, ["n_proposals", "n_outcomes"]).where("n_proposals <> 1 OR n_outcomes <> 1")


def tail_fnr(df: DataFrame, score: str, positive: Column, rare: Column, supported: Column, cut: float) -> DataFrame:
    """Recall and false-negative rate on rare positives inside the support."""
    hit = F.when(positive & rare & supported, (F.col(score) >= cut).cast("double"))
    return df.agg(F.count(hit).alias("n"), F.avg(hit).alias("recall")).withColumn("fnr", 1 - F.col("recall"))


def calibration(df: DataFrame, score: str, label: Column, bins: int = 10) -> DataFrame:
    """Predicted against observed rate by equal bins of a score in [0, 1]; the last bin is closed."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(label.cast("double")).alias("observed"))


def checked_scores(df: DataFrame, score: str) -> DataFrame:
    """df; rows whose score leaves [0, 1] fail when they are read."""
    ok = F.col(score).between(0, 1)
    return df.withColumn(score, F.when(ok, F.col(score)).otherwise(F.raise_error(F.lit(f"{score} outside [0, 1]")).cast("double")))


def score_weights(df: DataFrame, score: str, weight: str = "w") -> DataFrame:
    """Bias strategy on the loss side: a utility_tilt column beside the untouched production weight."""
    return df.withColumn("utility_tilt", F.col(score)).withColumn("training_weight", F.col(weight) * F.col("utility_tilt"))
