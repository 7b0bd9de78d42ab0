"""The evaluation bundle: every metric of a model sample (q) against a target sample (p) as rows (metric, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.functions.expressions import finite, total
from pointgrain.operators import compare, dedup

NAN = float("nan")
#: Width of the buckets of log weights: a bucket's sum of squares stays far below the largest double.
BUCKET = 64.0


@dataclass(frozen=True)
class Plan:
    """What to evaluate. Columns log_p and log_q are scores of both sides' rows; log_weight is ln of a q row's importance
    weight, by default log_p - log_q. inside, soft and rare are the region test, the soft posterior of the rare
    component, and the label of rare p rows. What is not given is left out of the result."""

    columns: Sequence[str]
    log_p: str = "log_p"
    log_q: str = "log_q"
    log_weight: Column | None = None
    weight: str | None = None
    thresholds: Mapping[str, float] = field(default_factory=dict)
    levels: Sequence[float] = ()
    posterior: Column | None = None
    n_components: int = 0
    inside: Column | None = None
    soft: Column | None = None
    rare: Column | None = None
    target_mass: float | None = None
    ess_floor: float = 0.01
    atol: float | None = None
    key: str | None = None
    seed: int = 1


def evaluate(df: DataFrame, is_p: Column, plan: Plan) -> DataFrame:
    """All metrics of df, whose rows are p's where the condition holds and else q's. Everything that sums up comes from one
    scan (see aggregates). Quantiles come from a selection over both sides; with atol duplicates and near ones of q, and
    with key the two-sample test, from jobs of their own. q rows with a non-finite coordinate count for support and for
    the region's denominator and are left out elsewhere."""
    parts = [aggregates(df, is_p, plan)]
    side = [F.col(c) for c in plan.columns]
    whole = total([F.when(finite(c), 0).otherwise(1) for c in plan.columns]) == 0
    p, q = df.where(is_p), df.where(~is_p & whole)
    if plan.levels:
        found = compare.tail_quantile_error(p.select(*side), q.select(*side), plan.columns, plan.levels)
        cells = F.create_map(F.lit("p"), "q_p", F.lit("q"), "q_q", F.lit("abs_error"), "abs_error")
        parts.append(found.select(F.concat_ws(".", F.lit("tail"), "column", F.col("level").cast("string")).alias("at"), F.explode(cells).alias("what", "value")).select(F.concat_ws(".", "at", "what").alias("metric"), "value"))
    if plan.atol is not None:
        found = dedup.duplicates(q, plan.columns, plan.atol)
        doubles = all(t == "double" for _, t in q.select(*side).dtypes)
        parts.append(_long(found.drop("n_near") if doubles else dedup.exact_duplicates(q, plan.columns), "duplicates"))
        parts.append(_long(found.select("n_near"), "near_duplicates"))
    if plan.key is not None:
        found = compare.c2st(p, q, list(plan.columns), plan.key, plan.seed)
        parts.append(df.sparkSession.createDataFrame([(f"c2st.{k}", float(v)) for k, v in found.items()], "metric string, value double"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _long(one: DataFrame, name: str) -> DataFrame:
    """Rows (metric, value) from one row of numbers."""
    cells = F.array(*(F.struct(F.lit(f"{name}.{c}" if name else c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in one.columns))
    return one.select(F.explode(cells).alias("m")).select("m.*")


def aggregates(df: DataFrame, is_p: Column, plan: Plan) -> DataFrame:
    """The metrics that sums tell, from one scan.

    Importance weights are summed without knowing the largest: each goes to the bucket of its logarithm, and sums of a
    bucket are those of weights over the bucket's own scale. Such sums merge in partial aggregates, and the few buckets are
    brought to the largest weight's scale at the end. All p rows, and q rows without a weight, share one more bucket."""
    is_p = F.coalesce(is_p, F.lit(False))
    log_w = F.col(plan.log_p) - F.col(plan.log_q) if plan.log_weight is None else plan.log_weight
    whole = total([F.when(finite(c), 0).otherwise(1) for c in plan.columns]) == 0
    rows = df.withColumns({"_p": is_p, "_q": ~is_p, "_whole": whole, "_d": F.col(plan.log_p) - F.col(plan.log_q), "_lw": F.when(~is_p & whole & finite(log_w), log_w)})
    if plan.posterior is not None:
        rows = rows.withColumn("_post", F.when(F.col("_p"), plan.posterior))
    rows = rows.withColumn("_bucket", F.floor(F.col("_lw") / BUCKET))
    scaled = F.exp(F.col("_lw") - F.col("_bucket") * BUCKET)
    log_q, d = F.when(F.col("_p"), F.col(plan.log_q)), F.when(F.col("_p"), F.col("_d"))
    ok_q, ok_d = F.when(finite(log_q), log_q), F.when(finite(d), d)
    count = lambda c: F.count_if(c)
    of_p = {
        "n": count(F.col("_p")), "nll": -F.avg(ok_q), "n_nll": F.count(ok_q), "kl": F.avg(ok_d), "kl_std": F.stddev_pop(ok_d), "n_kl": F.count(ok_d),
    } | {f"post{k}": F.avg(F.get(F.col("_post"), F.lit(k))) for k in range(plan.n_components if plan.posterior is not None else 0)}
    if plan.rare is not None:
        of_p |= {"rare_log_q": F.avg(F.when(plan.rare, ok_q)), "rare_kl": F.avg(F.when(plan.rare, ok_d))}
    if plan.weight is not None:
        w = F.when(F.col("_p"), F.col(plan.weight))
        of_p |= {"w": F.sum(w), "w2": F.sum(w * w)}
    sums = {
        "n_q": count(F.col("_q")), "q_odd": count(F.col("_q") & ~F.col("_whole")), "q_pz": count(F.col("_q") & F.coalesce(F.col("pz") <= 0, F.lit(False))) if "pz" in plan.columns else F.lit(None).cast("long"),
        "q_whole": count(F.col("_q") & F.col("_whole")), "n_w": F.count("_lw"),
    }
    for c, t in plan.thresholds.items():
        sums |= {f"over|{c}|p": count(F.col("_p") & (F.col(c) > t)), f"over|{c}|q": count(F.col("_q") & F.col("_whole") & (F.col(c) > t))}
    if plan.inside is not None:
        sums["q_inside"] = count(F.col("_q") & F.col("_whole") & F.coalesce(plan.inside, F.lit(False)))
    if plan.soft is not None:
        soft = F.when(F.col("_q") & F.col("_whole"), plan.soft)
        sums |= {"soft": F.sum(soft), "n_soft": F.count(soft)}
    state = {"top": F.max("_lw"), "low": F.min("_lw"), "s": F.sum(scaled), "s2": F.sum(scaled * scaled)}
    buckets = rows.groupBy("_bucket").agg(*(c.alias(n) for n, c in (of_p | sums | state).items()))

    alone = F.col("_bucket").isNull()
    merged = buckets.agg(
        *(F.max(F.when(alone, F.col(n))).alias(n) for n in of_p), *(F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in sums),
        F.max("top").alias("top"), F.min("low").alias("low"), F.collect_list(F.when(~alone, F.struct(F.col("_bucket").alias("b"), "s", "s2"))).alias("parts"),
    )

    def at_top(name: str, power: int) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x[name] * F.exp(power * (x["b"] * BUCKET - F.col("top"))))

    one = merged.withColumns({"s": at_top("s", 1), "s2": at_top("s2", 2)})
    n, rate = F.coalesce("n", F.lit(0)), F.try_divide
    ess = rate(F.col("s") * F.col("s"), F.col("n_w") * F.col("s2"))
    out = {
        "held_out.nll": F.coalesce("nll", F.lit(NAN)), "held_out.n_nonfinite": n - F.coalesce("n_nll", F.lit(0)), "held_out.n": n, "nonfinite.rate": rate(n - F.coalesce("n_nll", F.lit(0)), n),
        "forward_kl.value": F.coalesce("kl", F.lit(NAN)), "forward_kl.std_error": F.when(F.col("n_kl") > 1, F.col("kl_std") / F.sqrt("n_kl")).otherwise(F.lit(NAN)), "forward_kl.n_finite": F.coalesce("n_kl", F.lit(0)), "forward_kl.n_nonfinite": n - F.coalesce("n_kl", F.lit(0)),
        "ess.ess_over_n": ess, "ess.max_weight": rate(F.lit(1.0), F.col("s")), "ess.log_min": F.col("low"), "ess.log_max": F.col("top"), "ess.log_range": F.col("top") - F.col("low"), "ess.n_excluded": F.col("n_q") - F.col("n_w"),
        "ess.catastrophic": F.coalesce(ess < plan.ess_floor, F.lit(True)).cast("int"),
        "support.nonfinite_rate": rate(F.col("q_odd"), F.col("n_q")), "support.pz_rate": rate(F.col("q_pz"), F.col("n_q")), "support.n_pz": F.col("q_pz"),
    }
    for c in plan.thresholds:
        a, b = rate(F.col(f"over|{c}|p"), n), rate(F.col(f"over|{c}|q"), F.col("q_whole"))
        out |= {f"exceedance.{c}.p": a, f"exceedance.{c}.q": b, f"exceedance.{c}.abs_error": F.abs(a - b)}
    out |= {f"posterior.{k}": F.col(f"post{k}") for k in range(plan.n_components if plan.posterior is not None else 0)}
    if plan.weight is not None:
        out["weight_ess.value"] = rate(F.col("w") * F.col("w"), F.col("w2"))
    if plan.inside is not None:
        mass = rate(F.col("q_inside"), F.col("n_q"))
        out |= {"rare.n_inside": F.col("q_inside"), "rare.mass": mass, "rare.zero": (F.col("q_inside") == 0).cast("int")}
        if plan.target_mass is not None:
            out |= {"rare.mass_ratio": mass / plan.target_mass, "rare.p_zero": F.pow(F.lit(1 - plan.target_mass), F.col("n_q"))}
    if plan.soft is not None:
        out["rare.soft_mass"] = rate(F.col("soft"), F.col("n_soft"))
    if plan.rare is not None:
        out |= {"rare.log_q": F.col("rare_log_q"), "rare.kl": F.col("rare_kl")}
    return _long(one.select(*(c.cast("double").alias(m) for m, c in out.items())), "")
