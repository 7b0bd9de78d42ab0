"""Column profiles: each is one aggregate pass; only the single result row is turned into long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.operators.selection import exact_quantiles
from pointgrain.sources.tables import CONTRACT_VERSION

#: The reported quantile levels.
LEVELS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def long_form(wide: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row for each column from the one row of cells named column|name."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}|{n}`").alias(n) for n in names)) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean and population standard deviation of each column, one row a column."""
    kinds = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    return long_form(df.agg(*(f(c).alias(f"{c}|{n}") for c in columns for n, f in kinds.items())), columns, list(kinds))


def column_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float] = LEVELS, accuracy: int | None = None) -> DataFrame:
    """Quantiles with linear interpolation, one row for each column and level: exact by distributed selection, which
    reads df a few times as the table is made, or with an accuracy approximate in one pass."""
    if not accuracy:
        rows = [r[1:] for r in exact_quantiles(df, columns, levels)]
        return df.sparkSession.createDataFrame(rows, "column string, level double, value double")
    wide = df.agg(*(F.percentile_approx(c, list(levels), accuracy).alias(f"{c}|q") for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("level"), F.col(f"`{c}|q`")[i].alias("value")) for c in columns for i, p in enumerate(levels)))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def id_histogram(df: DataFrame, column: str = "id") -> DataFrame:
    return df.groupBy(F.rint(column).cast("int").alias(column)).agg(F.count("*").alias("n"))


def row_code(columns: Sequence[str], scale: float = 1e6) -> Column:
    """60 bits of the MD5 of a row's cells as scaled integers, since engines spell doubles differently."""
    cells = [F.round(F.col(c) * scale).cast("long").cast("string") for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(CONTRACT_VERSION), *cells)), 1, 15), 16, 10).cast("decimal(38,0)")


def content_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fingerprint that any order and partitioning of the rows leaves alone: count and sum of row codes. Add a key
    column to make it depend on which row holds what."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row_code(columns)), F.lit(0)).cast("string").alias("code_sum")).select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "code_sum"), 256).alias("fingerprint"))


def fit_normalization(df: DataFrame, columns: Sequence[str], zero: str = "unit") -> DataFrame:
    """Mean and population standard deviation of each column of the given (training) rows; a zero deviation becomes 1,
    or an error if zero is 'error'."""
    stats = column_stats(df, columns).select("column", "mean", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("std"), (F.col("std") == 0).alias("constant"))
    if zero == "error" and stats.where("constant").count():
        raise ValueError("a feature has zero variance")
    return stats.drop("constant")


def parameters(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted (mean, std) by column: one row a column, so it may go through the driver and be inlined."""
    return {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}


def standardized(columns: dict[str, Column], fitted: dict[str, tuple[float, float]], inverse: bool = False) -> dict[str, Column]:
    return {n: c * fitted[n][1] + fitted[n][0] if inverse else (c - fitted[n][0]) / fitted[n][1] for n, c in columns.items()}
