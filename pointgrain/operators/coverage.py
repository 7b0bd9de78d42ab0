"""Which rows each arm of a comparison is defined on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.functions.expressions import finite

COMMON = "common"


def view_arms(columns: Sequence[str] = ("px", "py", "pz", "x", "y")) -> dict[str, dict[str, Column]]:
    """The reasons, in order, for which a row is outside each feature view."""
    odd = ~reduce(lambda a, b: a & b, map(finite, columns))
    low = F.coalesce(F.col("pz") <= 0, F.lit(False))
    return {"identity": {"nonfinite": odd}, "logpz": {"nonfinite": odd, "pz_not_positive": low}, "slope": {"nonfinite": odd, "pz_not_positive": low}}


def reason(reasons: Mapping[str, Column]) -> Column:
    """The first reason that holds, null for a valid row."""
    return reduce(lambda w, kv: w.when(kv[1], kv[0]), reasons.items(), F.when(F.lit(False), ""))


def valid_everywhere(arms: Mapping[str, Mapping[str, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [reason(r).isNull() for r in arms.values()])


def key_code(key: Column) -> Column:
    """60 bits of the MD5 of a key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("decimal(38,0)")


def domain_coverage(df: DataFrame, key: str, arms: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """One pass over df for all arms and their intersection (arm 'common'): rows (arm, valid, reason, n, fingerprint).

    valid and reason are null on the row of all rows of an arm; reason is null on those of all its valid and all its
    invalid rows. A fingerprint is the SHA-256 of count and sum of the keys' codes, so it hangs on which rows are there and
    not on their order. A row enters once for each arm and collapses in the partial aggregate."""
    arms = view_arms() if arms is None else arms
    marks = [F.struct(F.lit(n).alias("arm"), reason(r).alias("reason")) for n, r in arms.items()]
    marks.append(F.struct(F.lit(COMMON).alias("arm"), F.when(~valid_everywhere(arms), "outside an arm").alias("reason")))
    spread = df.select(key_code(F.col(key)).alias("code"), F.explode(F.array(*marks)).alias("m")).select("code", "m.arm", F.col("m.reason").isNull().alias("valid"), "m.reason")
    sets = spread.groupingSets([["arm"], ["arm", "valid"], ["arm", "valid", "reason"]], "arm", "valid", "reason")
    sums = sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.coalesce(F.sum("code"), F.lit(0)).cast("string").alias("total"))
    rows = sums.where("level > 0 OR NOT valid")  # the finest set of valid rows says the same as the one above it
    return rows.select("arm", "valid", "reason", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "total"), 256).alias("fingerprint"))


def common_valid(df: DataFrame, arms: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """The rows on which all arms are defined."""
    return df.where(valid_everywhere(view_arms() if arms is None else arms))


def native_coverage(df: DataFrame, arms: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """Share of all rows on which each arm is defined."""
    arms = view_arms() if arms is None else arms
    one = df.agg(F.count("*").alias("n_rows"), *(F.count_if(reason(r).isNull()).alias(f"v_{n}") for n, r in arms.items()))
    rows = [F.struct(F.lit(n).alias("arm"), "n_rows", F.col(f"v_{n}").alias("n_valid"), F.try_divide(f"v_{n}", "n_rows").alias("coverage")) for n in arms]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
