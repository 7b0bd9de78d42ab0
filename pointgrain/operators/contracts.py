"""Contract checks: row predicates and one aggregate pass over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.functions.expressions import finite, total
from pointgrain.sources.tables import FEATURES, STATE_COLUMNS

#: Largest absolute momentum and position.
BOUNDS = dict.fromkeys(("px", "py", "pz"), 1e4) | dict.fromkeys(("x", "y", "z"), 1e3)
CHECKS = ("shape", "finite", "weights", "ids", "bounds")


class ContractError(ValueError):
    """A table breaks the contract; check names the first check that fails."""

    def __init__(self, check: str, n: int):
        super().__init__(f"check {check} fails: {n}")
        self.check, self.n = check, n


def violations(zero_weight: bool = False, bounds: Mapping[str, float] = BOUNDS) -> dict[str, Column]:
    """How often a row breaks each check; a non-finite cell counts for `finite` only."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    return {
        "finite": total([flag(~finite(c)) for c in STATE_COLUMNS]),
        "weights": flag(F.coalesce(F.col("w") < 0 if zero_weight else F.col("w") <= 0, F.lit(False))),
        "ids": flag(finite("id") & (F.col("id") != F.rint("id"))),
        "bounds": total([flag(finite(c) & (F.abs(c) > b)) for c, b in bounds.items()]),
    }


def contract_checks(df: DataFrame, allowed: Sequence[str] = (), **options) -> DataFrame:
    """One row for each check in fixed order: check, passed, n (violations; rows for shape). A column set other than the
    state's, but for allowed ones beside it, fails the shape at once."""
    if sorted(c for c in df.columns if c not in allowed) != sorted(STATE_COLUMNS):
        raise ContractError("shape", len(df.columns))
    counts = violations(**options)
    one = df.agg(F.count("*").alias("shape"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counts.items()))
    rows = [F.struct(F.lit(i).alias("no"), F.lit(n).alias("check"), (F.col(n) > 0 if n == "shape" else F.col(n) == 0).alias("passed"), F.col(n).cast("long").alias("n")) for i, n in enumerate(CHECKS)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validate(df: DataFrame, **options) -> DataFrame:
    """df itself; raises the first failing check, all counted in one pass."""
    for row in sorted(contract_checks(df, **options).collect(), key=lambda r: r["no"]):
        if not row["passed"]:
            raise ContractError(row["check"], row["n"])
    return df


def reasons(**options) -> Column:
    """Names of the checks that a row breaks."""
    return F.array_compact(F.array(*(F.when(c > 0, F.lit(n)) for n, c in violations(**options).items())))


def quarantine(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid rows with their reasons; neither side needs a shuffle."""
    marked = df.withColumn("reasons", reasons(**options))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def weight_check(df: DataFrame, weight: str = "w") -> DataFrame:
    return df.agg(F.count_if(~finite(weight)).alias("n_nonfinite"), F.count_if(F.col(weight) < 0).alias("n_negative"), F.sum(F.when(finite(weight), F.col(weight))).alias("total")).withColumn("valid", (F.col("n_nonfinite") == 0) & (F.col("n_negative") == 0) & (F.coalesce("total", F.lit(0.0)) > 0))


def unexpected_ids(df: DataFrame, expected: Sequence[float] = (13.0, -13.0), column: str = "id") -> DataFrame:
    return df.where(~F.col(column).isin(*expected)).groupBy(column).agg(F.count("*").alias("n"))


def domain_check(df: DataFrame) -> DataFrame:
    """Rows outside the domain of the logarithmic views, and rows with a non-finite modelled coordinate."""
    bad = ~(finite("px") & finite("py") & finite("pz") & finite("x") & finite("y"))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col("pz") <= 0, F.lit(False))).alias("n_pz_not_positive"), F.count_if(bad).alias("n_nonfinite"))


def require_domain(df: DataFrame) -> DataFrame:
    """df itself; raises when a view with ln(pz) would not be defined on all rows."""
    row = domain_check(df).first()
    for name in ("n_pz_not_positive", "n_nonfinite"):
        if row[name]:
            raise ContractError(name, row[name])
    return df


def embed_state(df: DataFrame, z: float, pdg_id: int, weight: float = 1.0) -> DataFrame:
    """Five physical columns to the eight of the state table."""
    if pdg_id not in (13, -13) or not abs(z) < float("inf"):
        raise ValueError("id must be 13 or -13 and z finite")
    return df.select("px", "py", "pz", "x", "y", F.lit(float(z)).alias("z"), F.lit(float(pdg_id)).alias("id"), F.lit(float(weight)).alias("w")).select(*FEATURES, "id", "w")


def leakage(df: DataFrame, part: str, key: str) -> DataFrame:
    """Keys that occur in more than one part of a split."""
    return df.groupBy(key).agg(F.count_distinct(part).alias("parts")).where("parts > 1")
