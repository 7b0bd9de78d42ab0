"""Comparison of a target sample (p) with a model sample (q). Every metric is one or two aggregate passes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgrain.functions.expressions import finite, hash_uniform, total
from pointgrain.operators import profile
from pointgrain.operators.selection import exact_quantiles

NAN = float("nan")


def held_out_nll(df: DataFrame, log_q: str) -> DataFrame:
    """Mean of -log q over finite rows (NaN if there is none) and the count of other rows."""
    return df.agg(F.coalesce(F.avg(F.when(finite(log_q), -F.col(log_q))), F.lit(NAN)).alias("held_out_nll"), F.count_if(~finite(log_q)).alias("n_nonfinite"), F.count("*").alias("n"))


def forward_kl(df: DataFrame, log_p: str, log_q: str) -> DataFrame:
    """Mean of log p - log q over finite differences, and its standard error (NaN for one row or none)."""
    d = F.col(log_p) - F.col(log_q)
    ok = F.when(finite(d), d)
    one = df.agg(F.coalesce(F.avg(ok), F.lit(NAN)).alias("forward_kl"), F.stddev_pop(ok).alias("std"), F.count(ok).alias("n_finite"), F.count_if(~finite(d)).alias("n_nonfinite"))
    return one.select("forward_kl", F.when(F.col("n_finite") > 1, F.col("std") / F.sqrt("n_finite")).otherwise(F.lit(NAN)).alias("std_error"), "n_finite", "n_nonfinite")


def importance_ess(df: DataFrame, log_w: str, threshold: float = 0.01, drop: bool = False) -> DataFrame:
    """ESS / N of importance weights exp(log_w), shifted by their maximum in a second pass. Non-finite log weights are
    an error unless drop, which leaves them out and counts them; no row left is an error. catastrophic: strictly
    below the threshold."""
    ok = finite(log_w)
    first = df.agg(F.max(F.when(ok, F.col(log_w))).alias("top"), F.min(F.when(ok, F.col(log_w))).alias("low"), F.count_if(~ok).alias("bad"), F.count_if(ok).alias("n")).first()
    if first["bad"] and not drop:
        raise ValueError(f"{first['bad']} log weights are not finite")
    if not first["n"]:
        raise ValueError("no finite log weight")
    # No filter: Spark would push it below the projections that make log_w, and write their expressions out again.
    w = F.when(ok, F.exp(F.col(log_w) - F.lit(first["top"])))
    one = df.agg(F.sum(w).alias("s"), F.sum(w * w).alias("s2"))
    ess = F.col("s") * F.col("s") / (first["n"] * F.col("s2"))
    return one.select(ess.alias("ess_over_n"), (1 / F.col("s")).alias("max_weight"), F.lit(first["low"]).alias("log_min"), F.lit(first["top"]).alias("log_max"), F.lit(first["top"] - first["low"]).alias("log_range"), F.lit(first["bad"]).alias("n_nonfinite"), (ess < threshold).alias("catastrophic"))


def weight_ess(df: DataFrame, weight: str) -> DataFrame:
    w = F.col(weight)
    return df.agg(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("ess"), F.count("*").alias("n"))


def tail_quantile_error(p: DataFrame, q: DataFrame, columns: Sequence[str], levels: Sequence[float] = (0.01, 0.99), accuracy: int | None = None) -> DataFrame:
    """Quantiles of p and q and their absolute difference, one row for each column and level. Both sides go through one
    selection; with an accuracy they are approximate."""
    if not accuracy:
        both = p.select(*columns, F.lit(1).alias("_side")).unionByName(q.select(*columns, F.lit(0).alias("_side")))
        found = {r[:3]: r[3] for r in exact_quantiles(both, columns, levels, F.col("_side"))}
        rows = [(c, float(level), found.get((1, c, float(level))), found.get((0, c, float(level)))) for c in columns for level in levels]
        joined = p.sparkSession.createDataFrame(rows, "column string, level double, q_p double, q_q double")
    else:
        a = profile.column_quantiles(p, columns, levels, accuracy).withColumnRenamed("value", "q_p")
        b = profile.column_quantiles(q, columns, levels, accuracy).withColumnRenamed("value", "q_q")
        joined = a.join(b, ["column", "level"])
    return joined.withColumn("abs_error", F.abs(F.col("q_p") - F.col("q_q")))


def exceedance_error(p: DataFrame, q: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """P(c > t) of both sides and their absolute difference, one row a column. Both sides go through one pass."""
    both = p.select(*thresholds, F.lit(True).alias("is_p")).unionByName(q.select(*thresholds, F.lit(False).alias("is_p")))
    share = lambda c, t, side: F.avg(F.when(side, (F.col(c) > t).cast("double")))
    one = both.agg(*(share(c, t, s).alias(f"{c}|{n}") for c, t in thresholds.items() for n, s in (("p_p", F.col("is_p")), ("p_q", ~F.col("is_p")))))
    return profile.long_form(one, list(thresholds), ["p_p", "p_q"]).withColumn("abs_error", F.abs(F.col("p_p") - F.col("p_q")))


def nonfinite_rate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(~finite(column)).alias("n_nonfinite"), F.count("*").alias("n")).withColumn("rate", F.try_divide("n_nonfinite", "n"))


def support_violation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shares of rows with a non-finite cell and of rows with pz <= 0."""
    bad = total([F.when(finite(c), 0).otherwise(1) for c in columns]) > 0
    low = F.coalesce(F.col("pz") <= 0, F.lit(False))
    return df.agg(F.avg(bad.cast("double")).alias("nonfinite_rate"), F.avg(low.cast("double")).alias("pz_rate"), F.count_if(low).alias("n_pz"))


def rare_region(df: DataFrame, inside: Column, target_mass: float, log_p: Column | None = None, log_q: Column | None = None, posterior: Column | None = None, rare: Column | None = None) -> DataFrame:
    """Mass of a region among all rows and against its target mass, the chance to see none in as many draws, the mean
    soft posterior, and mean log q and KL over rows labelled rare. Rows that are not decidable count as outside."""
    hit = F.coalesce(inside, F.lit(False))
    aggs = [F.count("*").alias("n"), F.count_if(hit).alias("n_inside")]
    aggs += [F.avg(posterior).alias("soft_mass")] if posterior is not None else []
    if rare is not None and log_p is not None and log_q is not None:
        d = log_p - log_q
        aggs += [F.avg(F.when(rare & finite(log_q), log_q)).alias("rare_log_q"), F.avg(F.when(rare & finite(d), d)).alias("rare_kl")]
    mass = F.try_divide("n_inside", "n")
    return df.agg(*aggs).withColumns({"mass": mass, "mass_ratio": mass / target_mass, "p_zero": F.pow(F.lit(1 - target_mass), F.col("n")), "zero": F.col("n_inside") == 0})


def region_calibration(df: DataFrame, inside: Column, rare: Column) -> DataFrame:
    """P(region), its binomial standard error, and the share of in-region rows from other components."""
    hit = F.coalesce(inside, F.lit(False))
    one = df.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_inside"), F.count_if(hit & ~rare).alias("n_other"))
    p = F.col("n_inside") / F.col("n")
    return one.select("n", "n_inside", p.alias("probability"), F.sqrt(p * (1 - p) / F.col("n")).alias("std_error"), F.coalesce(F.try_divide("n_other", "n_inside"), F.lit(0.0)).alias("contamination"))


def histogram_pull(p: DataFrame, q: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Normalized histograms of both sides over a fixed range (the last bin is closed) with sqrt(n) errors. pull divides
    the difference of counts by the errors of the normalized counts, on another scale; pull_consistent
    divides the difference of normalized counts by them."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    side = lambda df, s: df.where(F.col(column).between(low, high)).select(at.alias("bin"), F.lit(s).alias("side"))
    counts = side(p, 1).unionByName(side(q, 0)).groupBy("bin").agg(F.sum("side").alias("n_p"), F.sum(1 - F.col("side")).alias("n_q"))
    spine = p.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(F.broadcast(counts), "bin", "left").fillna(0, ["n_p", "n_q"])  # counts: a row for each bin
    everything = Window.partitionBy(F.lit(0))
    full = full.withColumns({"t_p": F.sum("n_p").over(everything), "t_q": F.sum("n_q").over(everything)})
    e_p, e_q = F.try_divide(F.sqrt("n_p"), F.col("t_p") * width), F.try_divide(F.sqrt("n_q"), F.col("t_q") * width)
    full = full.withColumns({"d_p": F.try_divide("n_p", F.col("t_p") * width), "d_q": F.try_divide("n_q", F.col("t_q") * width), "e": F.sqrt(e_p * e_p + e_q * e_q)})
    pull = lambda d: F.coalesce(F.try_divide(d, F.col("e")), F.lit(0.0))
    return full.select("bin", "n_p", "n_q", "d_p", "d_q", pull(F.col("n_p") - F.col("n_q")).alias("pull"), pull(F.col("d_p") - F.col("d_q")).alias("pull_consistent"))


def labelled_union(p: DataFrame, q: DataFrame, columns: Sequence[str]) -> DataFrame:
    return p.select(*columns, F.lit(1).alias("label")).unionByName(q.select(*columns, F.lit(0).alias("label")))


def stratum_nll(df: DataFrame, nll: str, weight: str, rare: str) -> DataFrame:
    """Weighted mean loss overall and by stratum; null for an empty one."""
    part = lambda c: F.try_divide(F.sum(F.when(c, F.col(weight) * F.col(nll))), F.sum(F.when(c, F.col(weight))))
    return df.agg(part(F.lit(True)).alias("all"), part(F.col(rare)).alias("rare"), part(~F.col(rare)).alias("main"))


def binomial_rates(df: DataFrame, group: Sequence[str], success: Column, level: float = 0.95) -> DataFrame:
    """Success rate of each group with its exact (Clopper-Pearson) interval. Spark counts; the bisection runs on the few
    aggregated rows, in batches."""
    counts = df.groupBy(*group).agg(F.count_if(success).alias("k"), F.count("*").alias("n"))

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), level) for a, b in zip(k, n, strict=True)], columns=["low", "high"])

    return counts.withColumn("ci", interval("k", "n")).select(*group, "k", "n", (F.col("k") / F.col("n")).alias("rate"), "ci.low", "ci.high")


def beta_share(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by its continued fraction (Lentz's way): constant memory for any a and b. The
    fraction needs some sqrt(max(a, b)) steps; a bound far above that turns a value that does not settle into an error."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value, m = d, 0
    most = 1000 + 20 * math.isqrt(int(max(a, b)) + 1)
    while m == 0 or abs(c * d - 1) > 1e-14:
        m += 1
        if m > most:
            raise ArithmeticError(f"the continued fraction does not settle at {x}, {a}, {b}")
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d)
            c = 1 + term / c
            value *= c * d
    return value * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def clopper_pearson(k: int, n: int, level: float = 0.95, steps: int = 64) -> tuple[float, float]:
    """Exact binomial interval: bisection of the tail probabilities, which are incomplete beta functions."""

    def solve(a: int, b: int, share: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if beta_share(mid, a, b) > share else (mid, hi)
        return (lo + hi) / 2

    rest = (1 - level) / 2
    return (0.0 if k == 0 else solve(k, n - k + 1, rest)), (1.0 if k == n else solve(k + 1, n - k, 1 - rest))


def c2st(p: DataFrame, q: DataFrame, columns: Sequence[str], key: str, seed: int = 1) -> dict[str, float]:
    """Two-sample test by a classifier: sides balanced by a hash sample, split in halves by hash, features standardized
    on the training half, logistic regression; accuracy at 0.5 and ROC AUC on the other half. Same laws give 0.5."""
    sides = {1: p, 0: q}
    sizes = {s: df.count() for s, df in sides.items()}
    n = min(sizes.values())
    parts = [df.where(hash_uniform(F.col(key), F.lit(seed), F.lit("side")) < n / max(sizes[s], 1)).select(key, *columns, F.lit(float(s)).alias("label")) for s, df in sides.items()]
    both = parts[0].unionByName(parts[1]).withColumn("train", hash_uniform(F.col(key), F.lit(seed), F.lit("half")) < 0.5)
    fitted = profile.parameters(profile.fit_normalization(both.where("train"), columns))
    cells = profile.standardized({c: F.col(c) for c in columns}, fitted)
    rows = both.select("label", "train", array_to_vector(F.array(*cells.values())).alias("features")).cache()
    n_train = rows.where("train").count()
    model = LogisticRegression(regParam=1.0 / max(n_train, 1), standardization=False).fit(rows.where("train"))
    scored = model.transform(rows.where(~F.col("train")))
    accuracy = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(scored)
    rows.unpersist()
    return {"accuracy": accuracy, "auc": auc, "n_train": n_train}


def bootstrap_metric(df: DataFrame, value: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """Means of n bootstrap resamples: each row enters resample b with a Poisson(1) count drawn from its hash. The rows
    are read once and spread over the n resamples inside the partial aggregate."""
    u = hash_uniform(F.col(key), F.lit(seed), F.col("b"))
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    count = total([(u >= c).cast("double") for c in cuts])
    spread = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    return spread.groupBy("b").agg((F.sum(F.col(value) * count) / F.sum(count)).alias("mean"))
