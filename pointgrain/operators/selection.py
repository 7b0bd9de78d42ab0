"""Exact quantiles by distributed selection: ranges are counted, narrowed to those that hold the wanted ranks, and only these are ordered."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgrain.functions.expressions import place

#: Rows of a range that one task orders, at most; wider ranges are cut into PARTS ranges at approximate quantiles and
#: counted again. ACCURACY of these quantiles moves work, never results.
ORDERED, PARTS, ACCURACY = 200_000, 256, 2_000


def long_values(df: DataFrame, columns: Sequence[str], series: Column | None = None) -> DataFrame:
    """Rows (series, no, value) of the cells that are not null: no counts the columns."""
    cells = F.array(*(F.col(c).cast("double") for c in columns))
    return df.select((F.lit(0) if series is None else series.cast("int")).alias("series"), F.posexplode(cells).alias("no", "value")).where("value IS NOT NULL")


def upto(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value <= high)


def narrowed(values: DataFrame, open_: list[dict]) -> dict[tuple, list[tuple]]:
    """For each open interval (series, no, low, high) its parts (low, high, number of rows), in order, from two passes:
    approximate quantiles tell where to cut, then all rows are counted."""
    spark = values.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r["series"], r["no"], r["low"], r["high"]) for r in open_], "series int, no int, low double, high double"))
    inside = values.join(wanted, ["series", "no"]).where(upto(F.col("value"), F.col("low"), F.col("high")))
    by = ["series", "no", "low", "high"]
    levels = [i / PARTS for i in range(1, PARTS)]
    cuts = inside.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("value", levels, ACCURACY))).alias("cuts"))
    placed = inside.join(F.broadcast(cuts), by).withColumn("part", place(F.col("cuts"), F.col("value")))  # as many rows as open intervals
    parts = placed.groupBy(*by, "part").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    out: dict[tuple, list[tuple]] = {}
    for r in parts.orderBy("series", "no", "low", "part").collect():  # PARTS + 1 rows for each open interval
        out.setdefault(tuple(r[c] for c in by), []).append((r["least"], r["most"], r["n"]))
    return out


def ranked_values(values: DataFrame, ranks: dict[tuple[int, int], set[int]], sizes: dict[tuple[int, int], tuple]) -> dict[tuple[int, int, int], float]:
    """(series, no, rank) -> value at that rank (from 0) among the rows of (series, no), in order of value (NaN last).
    sizes: (rows, least, most) of each (series, no)."""
    spark, found = values.sparkSession, {}
    todo = [{"series": s, "no": c, "low": sizes[s, c][1], "high": sizes[s, c][2], "n": sizes[s, c][0], "before": 0, "ranks": set(r)} for (s, c), r in ranks.items() if (s, c) in sizes]
    ready: list[dict] = []
    while todo:
        open_ = []
        for t in todo:
            if t["low"] == t["high"] or (math.isnan(t["low"]) and math.isnan(t["high"])):
                found |= {(t["series"], t["no"], r): t["low"] for r in t["ranks"]}
            else:
                (ready if t["n"] <= ORDERED else open_).append(t)
        if not open_:
            break
        todo, parts = [], narrowed(values, open_)
        for t in open_:
            before = t["before"]
            for low, high, n in parts[t["series"], t["no"], t["low"], t["high"]]:
                inside = {r for r in t["ranks"] if before <= r < before + n}
                if inside:
                    todo.append(t | {"low": low, "high": high, "n": n, "before": before, "ranks": inside})
                before += n
    if ready:
        wanted = [(t["series"], t["no"], t["low"], t["high"], t["before"], sorted(t["ranks"])) for t in ready]
        asked = F.broadcast(spark.createDataFrame(wanted, "series int, no int, low double, high double, before long, ranks array<long>"))  # a row for each wanted range
        by = ["series", "no", "low", "before", "ranks"]
        some = values.join(asked, ["series", "no"]).where(upto(F.col("value"), F.col("low"), F.col("high"))).groupBy(*by, "value").agg(F.count("*").alias("n"))
        order = Window.partitionBy("series", "no", "low").orderBy("value")
        placed = some.withColumn("last", F.col("before") + F.sum("n").over(order) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
        hits = placed.select("series", "no", "value", F.explode(F.filter("ranks", lambda r: r.between(F.col("first"), F.col("last")))).alias("rank"))
        found |= {(r["series"], r["no"], r["rank"]): r["value"] for r in hits.collect()}  # the wanted ranks
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float], series: Column | None = None) -> list[tuple[int, str, float, float | None]]:
    """(series, column, level, value): quantiles with linear interpolation of each column, over the rows of each value of
    series (0 for all). Nulls are left out, NaN comes last; a column without values has null quantiles.

    No task ever holds a column's values: counts of ranges tell which ranges hold the wanted ranks, and only rows of these,
    ORDERED at most in a range, are ordered. What comes to the driver is a count for each range."""
    values = long_values(df, columns, series)
    counts = values.groupBy("series", "no").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    sizes = {(r["series"], r["no"]): (r["n"], r["low"], r["high"]) for r in counts}
    ranks: dict[tuple[int, int], set[int]] = {}
    for at, (n, *_) in sizes.items():
        for level in levels:
            ranks.setdefault(at, set()).update({math.floor(level * (n - 1)), math.ceil(level * (n - 1))})
    found, out = ranked_values(values, ranks, sizes), []
    for s in sorted({s for s, _ in sizes} or {0}):
        for no, column in enumerate(columns):
            for level in levels:
                value = None
                if (s, no) in sizes:
                    at = level * (sizes[s, no][0] - 1)
                    low, high = (found[s, no, r] for r in (math.floor(at), math.ceil(at)))
                    value = low if low == high else low + (high - low) * (at - math.floor(at))
                out.append((s, column, float(level), value))
    return out
