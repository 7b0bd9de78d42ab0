"""Analytics over tables of experiment runs: assembly, gates, summaries and resume logic."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointgrain.functions.expressions import finite

#: Verdicts by severity; report counts as pass.
SEVERITY = {"catastrophic": 3, "fail": 2, "inconclusive": 1, "pass": 0, "report": 0}
VERDICTS = ("catastrophic", "fail", "inconclusive", "pass")
SERIES_ORDER = ("D0", "D1", "D2", "D3", "D4", "D5")


# Sources and sinks.


def read_runs(spark: SparkSession, root: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """Run records from root/*/name.json: one status, config and metrics document in each run folder. Folders without a
    status are skipped; a missing or corrupt config or metrics document is null."""
    parts = {}
    for name, schema in schemas.items():
        whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
        reader = spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        docs = reader.json(f"{root}/*/{name}.json").withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
        body = F.when(F.col("_corrupt").isNull(), F.struct(*(f.name for f in schema.fields)))
        parts[name] = docs.select("run_dir", body.alias(name))
    names = list(schemas)
    return reduce(lambda a, n: a.join(parts[n], "run_dir", "left"), names[1:], parts[names[0]])


def write_report(summary: DataFrame, path: str) -> None:
    """The summary as JSON and as CSV with a header."""
    summary.write.json(f"{path}/json")
    summary.write.option("header", True).csv(f"{path}/csv")


def assemble(status: DataFrame, config: DataFrame, metrics: DataFrame, key: str = "run_id") -> DataFrame:
    return status.join(config, key, "left").join(metrics, key, "left")


# Gates: classes of values, then verdicts.


def number_class(c: Column, raw: Column | None = None) -> Column:
    """missing, malformed (present in the raw text but no number), nonfinite or finite."""
    there = raw.isNotNull() if raw is not None else F.lit(False)
    return F.when(c.isNull() & there, "malformed").when(c.isNull(), "missing").when(~finite(c), "nonfinite").otherwise("finite")


def count_class(c: Column) -> Column:
    """missing, impossible (negative, fractional or not finite), zero or positive."""
    return F.when(c.isNull(), "missing").when(~finite(c) | (c < 0) | (c != F.floor(c)), "impossible").when(c == 0, "zero").otherwise("positive")


def rate_class(c: Column) -> Column:
    """missing, impossible (outside [0, 1] or not finite), zero or positive."""
    return F.when(c.isNull(), "missing").when(~finite(c) | (c < 0) | (c > 1), "impossible").when(c > 0, "positive").otherwise("zero")


def gate_finiteness(scalars: Sequence[Column], counters: Sequence[Column], rates: Sequence[Column]) -> Column:
    """A non-finite scalar or a positive counter or rate is catastrophic and wins; else anything unusable leaves it open."""
    numbers, counts, shares = map(number_class, scalars), list(map(count_class, counters)), list(map(rate_class, rates))
    numbers = list(numbers)
    any_of = lambda cs, *kinds: reduce(lambda a, b: a | b, [c.isin(*kinds) for c in cs], F.lit(False))
    bad = any_of(numbers, "nonfinite") | any_of(counts, "positive") | any_of(shares, "positive")
    open_ = any_of(numbers, "missing", "malformed") | any_of([*counts, *shares], "missing", "impossible")
    return F.when(bad, "catastrophic").when(open_, "inconclusive").otherwise("pass")


def gate_ess(ess: Column, threshold: float | Column, error: Column | None = None) -> Column:
    """Below the threshold or not finite is catastrophic, equal passes; an error without value is catastrophic too."""
    flagged = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    return F.when(ess.isNull() & flagged, "catastrophic").when(ess.isNull(), "inconclusive").when(~finite(ess) | (ess < threshold), "catastrophic").otherwise("pass")


def gate_rare(applies: Column, present: Column, count: Column, absent: str = "inconclusive") -> Column:
    """Null where the gate does not apply. absent: the verdict for a run without the block, inconclusive or report."""
    kind = count_class(count)
    return F.when(~applies, F.lit(None)).when(~F.coalesce(present, F.lit(False)), absent).when(kind == "positive", "pass").otherwise("inconclusive")


def gate_threshold(gate: Column, evaluation: Column) -> Column:
    """The gate's own threshold or else the evaluation's; null marks a contradiction, which require_threshold refuses."""
    return F.when(gate.isNotNull() & evaluation.isNotNull() & (gate != evaluation), F.lit(None)).otherwise(F.coalesce(gate, evaluation))


def require_threshold(gate: Column, evaluation: Column) -> Column:
    """gate_threshold, with a contradiction as an error of the row."""
    clash = gate.isNotNull() & evaluation.isNotNull() & (gate != evaluation)
    return F.when(clash, F.raise_error(F.lit("the gate's threshold contradicts the evaluation's")).cast("double")).otherwise(F.coalesce(gate, evaluation))


def rollup(gates: DataFrame, key: str = "run_id") -> DataFrame:
    """Of long rows (key, gate, outcome): the most severe outcome of each run and the gates above pass, in name order."""
    severity = reduce(lambda w, kv: w.when(F.col("outcome") == kv[0], kv[1]), SEVERITY.items(), F.when(F.lit(False), 0))
    top = F.max(severity)
    verdict = reduce(lambda w, kv: w.when(top == SEVERITY[kv], kv), VERDICTS, F.when(F.lit(False), ""))
    reasons = F.array_join(F.array_sort(F.collect_set(F.when(severity > 0, F.col("gate")))), ",")
    return gates.where("outcome IS NOT NULL").groupBy(key).agg(verdict.alias("verdict"), reasons.alias("reasons"))


# Summaries.


def run_summary(runs: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Completed runs by group: mean and population deviation of each metric over runs that are not catastrophic (a null
    verdict is clean and counts as unknown), a count of each verdict. One value or none has deviation 0."""
    clean = ~F.col("verdict").eqNullSafe("catastrophic")
    value = lambda m: F.when(clean & finite(m), F.col(m))
    aggs = [F.count("*").alias("n"), F.count_if(F.col("verdict").isNull()).alias("n_unknown")]
    aggs += [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS]
    aggs += [x for m in metrics for x in (F.avg(value(m)).alias(f"{m}_mean"), F.coalesce(F.stddev_pop(value(m)), F.lit(0.0)).alias(f"{m}_std"))]
    return runs.where("technical = 'completed'").groupBy(*group).agg(*aggs)


def run_counts(runs: DataFrame) -> DataFrame:
    """One row: all runs, completed and failed ones, and those of each verdict; a null verdict counts for none."""
    status = lambda v: F.count_if(F.col("technical") == v)
    return runs.agg(F.count("*").alias("n"), status("completed").alias("n_completed"), status("failed").alias("n_failed"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS))


LISTS = ("catastrophic", "inconclusive", "zero_rare")


def listed(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows (kind, key) of the runs that the gate summary lists; a run may be in several lists."""
    zero = F.col("target").startswith("D5") & (F.col("rare_count") == 0)
    kinds = F.array(F.when(F.col("verdict") == "catastrophic", "catastrophic"), F.when(F.col("verdict") == "inconclusive", "inconclusive"), F.when(zero, "zero_rare"))
    return runs.select(F.explode(F.array_compact(kinds)).alias("kind"), F.col(key).alias("key"))


def gate_summary(runs: DataFrame, key: str = "run_id", most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(summary, overflow) of judged runs (columns technical, verdict, scope, target, rare_count).

    summary is one row: n_runs, decision_scope (the sorted distinct scopes), counts by technical status ('unknown' for
    null) and by verdict as maps, and for each of LISTS the number of its runs and the first of them by key, at most `most`.
    Row numbers up to a limit are cut in each task before anything is shuffled, so a list never grows beyond its bound.
    overflow has the (kind, key) of all listed runs that the lists leave out, so no failed run gets out of sight."""
    counts = lambda c: runs.groupBy(c.alias("name")).agg(F.count("*").alias("n")).where("name IS NOT NULL").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("m"))  # noqa: E731  a few names
    rows = listed(runs, key)
    numbers = rows.groupBy("kind").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy("key")
    first = rows.withColumn("no", F.row_number().over(order)).where(F.col("no") <= most)
    lists = first.groupBy("kind").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.max("key").alias("last"))  # at most `most` a list
    per_kind = {r["kind"]: r for r in numbers.join(lists, "kind").collect()}  # three rows
    kind = dict(rows.dtypes)["key"]
    scopes = runs.agg(F.count("*").alias("n_runs"), F.sort_array(F.collect_set("scope")).alias("decision_scope"))
    one = scopes.crossJoin(counts(F.coalesce("technical", F.lit("unknown"))).withColumnRenamed("m", "technical_counts")).crossJoin(counts(F.col("verdict")).withColumnRenamed("m", "verdict_counts"))  # one row each
    for name in LISTS:
        found = per_kind.get(name)
        keys = F.lit(found["keys"]).cast(f"array<{kind}>") if found else F.array().cast(f"array<{kind}>")
        one = one.withColumns({f"n_{name}": F.lit(found["n"] if found else 0).cast("long"), f"{name}_runs": keys})
    beyond = reduce(lambda a, b: a | b, [(F.col("kind") == n) & (F.col("key") > F.lit(r["last"])) for n, r in per_kind.items() if r["n"] > most], F.lit(False))
    return one, rows.where(beyond).select("kind", F.col("key").alias(key))


def series_stats(runs: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    ok = F.when(finite(metric), F.col(metric))
    return runs.where("technical = 'completed'").groupBy(*group).agg(F.avg(ok).alias("mean"), F.coalesce(F.stddev_pop(ok), F.lit(0.0)).alias("std"), F.count(ok).alias("n"))


def long_numbers(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Rows (key, name, value) of the finite numbers among the columns; nested fields have dotted names, true is 1."""
    kinds = dict(flat_types(df.schema))
    cells = [(c, F.col(c).cast("double")) for c in columns if kinds[c] in ("double", "float", "bigint", "int", "boolean", "smallint", "tinyint")]
    return df.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in cells))).alias("m")).select(key, "m.*").where(finite("value"))


def long_strings(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(key, F.explode(F.array(*cells)).alias("m")).select(key, "m.*").where("value IS NOT NULL")


def flat_types(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted name, type) of all leaves of a schema."""
    out = []
    for f in schema.fields:
        out += flat_types(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else [(prefix + f.name, f.dataType.simpleString())]
    return out


def run_key(labels: Sequence[Column], config: Column) -> Column:
    """Cleaned labels and the first 12 hexadecimal digits of the configuration's SHA-256."""
    clean = [F.regexp_replace(c.cast("string"), "[^A-Za-z0-9_.-]+", "-") for c in labels]
    return F.concat_ws("__", *clean, F.substring(F.sha2(config, 256), 1, 12))


def series_label(target: Column, variant: Column) -> Column:
    """The target's name; D5, the only one with variants of its own, has its variant behind it."""
    return F.when((target != "D5") | variant.isNull() | (variant == "default"), target).otherwise(F.concat_ws("-", target, F.regexp_replace(variant, "^rare_", "")))


def series_order(target: Column) -> Column:
    return reduce(lambda w, kv: w.when(target == kv[1], kv[0]), enumerate(SERIES_ORDER), F.when(F.lit(False), 0)).otherwise(99)


def best_epoch(history: DataFrame, run: str, epoch: str, loss: str, patience: int, tolerance: float = 1e-9) -> DataFrame:
    """Best epoch of each run, and the epoch at which training stops: the first that is patience epochs past the last
    improvement by more than the tolerance over the kept best. The rule is sequential, so each run's history, which is
    as long as its training, is folded."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("best_epoch"), F.lit(0).alias("stale"), F.lit(None).cast("long").alias("stop_epoch"))

    def step(acc, x):
        better = x["loss"] < acc["best"] - tolerance
        stale = F.when(better, 0).otherwise(acc["stale"] + 1)
        now = F.struct(F.when(better, x["loss"]).otherwise(acc["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(acc["best_epoch"]).alias("best_epoch"), stale.alias("stale"), F.when(stale >= patience, x["epoch"]).alias("stop_epoch"))
        return F.when(acc["stop_epoch"].isNotNull(), acc).otherwise(now)

    rows = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("epoch"), F.col(loss).alias("loss"))))
    folded = history.groupBy(run).agg(rows.alias("h")).select(run, F.aggregate("h", start, step).alias("r"))
    return folded.select(run, "r.best_epoch", F.col("r.best").alias("best_loss"), "r.stop_epoch")


# Resume and comparison.


def resume_pending(planned: DataFrame, stored: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned runs without a completed one whose stored hash, where there is one, is equal."""
    done = stored.where("technical = 'completed'").select(F.col(key).alias("done_key"), F.col("config_hash").alias("done_hash"))
    return planned.join(done, (F.col(key) == F.col("done_key")) & (F.col("done_hash").isNull() | (F.col("done_hash") == F.col("config_hash"))), "left_anti")


def resume_verdict(planned: DataFrame, stored: DataFrame, key: str = "run_id") -> DataFrame:
    kept = stored.select(key, F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("unavailable").alias("verdict"))
    return planned.join(kept, key, "left")


def matched_arms(arms: DataFrame, keys: Sequence[str], arm: str, baseline: str, value: str) -> DataFrame:
    """Baseline and candidate arms side by side where all keys are equal, nulls included."""
    base = arms.where(F.col(arm) == baseline).select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col(value).alias("baseline"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys])
    return arms.where(F.col(arm) != baseline).join(base, same).select(*keys, arm, "baseline", F.col(value).alias("candidate"), (F.col(value) - F.col("baseline")).alias("gain"))


def grid(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """All combinations of the axes' distinct values; an axis has a handful of values."""
    return reduce(lambda a, b: a.crossJoin(b), [df.select(a).distinct() for a in axes])


def grid_gaps(expected: DataFrame, observed: DataFrame, axes: Sequence[str]) -> DataFrame:
    return expected.join(observed.select(*axes).distinct(), list(axes), "left_anti")


def grid_invalid(expected: DataFrame, valid: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Cells of a grid whose combination of these axes is not among the valid ones."""
    return expected.join(valid.select(*axes).distinct(), list(axes), "left_anti")


def select_runs(runs: DataFrame, **wanted: Iterable | None) -> DataFrame:
    """Runs whose columns lie in the given sets; None takes all."""
    for column, values in wanted.items():
        runs = runs if values is None else runs.where(F.col(column).isin(*values))
    return runs


def promotion(runs: DataFrame, by: Sequence[str], arm: str, baseline: str, seed: str, value: str, least: int, benefit: float) -> DataFrame:
    """For each candidate arm of a group the seeds that it passes for (a value is there) and the gain of its mean over the
    baseline arm's; promoted are those with enough seeds and at least the benefit."""
    arms = runs.groupBy(*by, arm).agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(seed))).alias("n_pass"), F.avg(value).alias("_mean"))
    base = arms.where(F.col(arm) == baseline).select(*by, F.col("_mean").alias("_base"))
    both = arms.where(F.col(arm) != baseline).join(base, list(by))
    gain = F.col("_mean") - F.col("_base")
    return both.select(*by, arm, "n_pass", gain.alias("gain"), ((F.col("n_pass") >= least) & (gain >= benefit)).alias("promoted"))


def min_sufficient(runs: DataFrame, by: Sequence[str], cost: str, model: str, seed: str, ok: Column, least: int) -> DataFrame:
    """For each group the cheapest model that is sufficient (ok) for enough seeds; ties go to the first name."""
    arms = runs.groupBy(*by, model, cost).agg(F.count_distinct(F.when(ok, F.col(seed))).alias("_n"))
    best = arms.where(F.col("_n") >= least).groupBy(*by).agg(F.min(F.struct(cost, model)).alias("_best"))
    return best.select(*by, f"_best.{cost}", f"_best.{model}")
