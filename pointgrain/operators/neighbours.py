"""Nearest neighbours of query vectors by a pivot index, exact over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.sources.tables import saved

#: Pivots, rows of a tile and queries of a slice, which are what a task holds, and queries that it compares at a time.
PIVOTS, TILE, SLICE, BLOCK = 64, 8192, 8192, 256
#: Part of a squared length by which a product of matrices may be wrong; within it distances are worked out anew.
DOUBT = 1e-10


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def moments(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation (1 for 0) of each coordinate of the vectors, from one scan."""
    row = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("vector")).alias("s")).select(vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), "s.count").first()
    std = np.sqrt(np.array(row["v"]) * (row["count"] - 1) / max(row["count"], 1))
    return row["m"], np.where(std > 0, std, 1.0).tolist()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs by a matrix product: close to the true ones, not exact."""
    return np.maximum(np.square(a).sum(1)[:, None] + np.square(b).sum(1) - 2 * a @ b.T, 0)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def grouped(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (code, vector) with group, the number of the nearest pivot, and reach, the distance to it."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(1), held.value.shape[1])
            at = distances(x, held.value).argmin(1)
            reach = np.sqrt(np.square(x - held.value[at]).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(reach)], ["code", "vector", "group", "reach"])

    return rows.select("code", "vector").mapInArrow(assign, "code long, vector array<double>, group int, reach double")


def met(rows: DataFrame, visits: DataFrame, length: int) -> DataFrame:
    """(number, least): the squared distance of each query of visits (group, number, code, vector) to its nearest row of the
    group (rows: group, code, vector) with another code. A group's rows are dealt into tiles and its queries into slices, and a
    task holds one tile and goes through one slice, so no group is too large for it."""
    dealt = lambda df, size: df.groupBy("group").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    tiles, slices = (dealt(df, size).withColumnRenamed("parts", name) for df, size, name in ((rows, TILE, "tiles"), (visits, SLICE, "slices")))
    sizes = F.broadcast(tiles.join(slices, "group"))  # a row for each pivot
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.withColumn("id", F.monotonically_increasing_id()).join(sizes, "group").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).select("group", "tile", each("slices").alias("slice"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("number"), "code", "vector")
    right = visits.join(sizes, "group").withColumn("slice", F.pmod(F.xxhash64("number"), F.col("slices")).cast("int")).select("group", each("tiles").alias("tile"), "slice", F.lit(1).alias("role"), "number", "code", "vector")
    cells = left.unionByName(right).repartition("group", "tile", "slice").sortWithinPartitions("group", "tile", "slice", "role")

    def nearest(batches):
        cell, held, tile = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if cell != tuple(keys[lo]):
                    cell, held, tile = tuple(keys[lo]), [], None
                part = batch.slice(lo, hi - lo)
                role = part.column(3).to_numpy()
                split = int(np.searchsorted(role, 1))
                if split:
                    held.append((part.column(5).to_numpy()[:split], matrix(part.column(6).slice(0, split), length)))
                for at in range(split, len(role), BLOCK) if held else ():
                    if tile is None:
                        tile = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    asked = part.slice(at, BLOCK)
                    yield pa.RecordBatch.from_arrays([asked.column(4), pa.array(closest(matrix(asked.column(6), length), asked.column(5).to_numpy(), *reversed(tile)))], ["number", "least"])

    found = cells.mapInArrow(nearest, "number long, least double")
    return found.where("least IS NOT NULL").groupBy("number").agg(F.min("least").alias("least"))


def closest(asked: np.ndarray, codes: np.ndarray, points: np.ndarray, names: np.ndarray) -> np.ma.MaskedArray:
    """Least squared distance of each asked vector to the points of another code; masked where there is none."""
    about = distances(asked, points)
    about[codes[:, None] == names] = np.inf
    low = about.min(1)
    doubt = DOUBT * (np.square(asked).sum(1) + np.square(points).sum(1).max())
    out = np.full(len(asked), np.inf)
    for i in np.flatnonzero(np.isfinite(low)):
        near = points[about[i] <= low[i] + 2 * doubt[i]]
        out[i] = np.square(near - asked[i]).sum(1).min()
    return np.ma.masked_invalid(out)


def nn_spread(df: DataFrame, vector: str, queries: DataFrame, key: str, normalized: bool = False) -> DataFrame:
    """(key, distance, visited): Euclidean distance of each query row (columns key and vector) to its nearest row of df with
    another key, over all rows and all coordinates, and how many rows of df were compared for it. normalized: coordinates
    are first brought to mean 0 and deviation 1 of df's.

    Rows are grouped by the nearest of PIVOTS rows. A query looks through its own group first; the distance found there,
    the pivots' distances and the groups' least and largest radius tell by the triangle inequality which other groups can
    hold a nearer row, and only these are visited. Queries stay in tables; what all tasks hold are the pivots.

    Rows without a vector, with components that are no finite numbers, or of another length than the first pivot, are neither
    queries nor neighbours; a query without any neighbour is left out. Keys may have any type and repeat."""
    spark = df.sparkSession
    clean = lambda x: x.select(F.col(key).alias("name"), F.xxhash64(F.col(key)).alias("code"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & (F.size("vector") > 0))
    rows, asked = clean(df), clean(queries)
    first = rows.orderBy(F.xxhash64("vector"), "vector").select("vector").first()
    empty = spark.createDataFrame([], asked.select(F.col("name").alias(key)).schema).withColumns({"distance": F.lit(None).cast("double"), "visited": F.lit(0).cast("long")})
    if first is None:
        return empty
    length = len(first["vector"])
    rows, asked = (x.where(F.size("vector") == length) for x in (rows, asked))
    if normalized:
        mean, std = moments(rows)
        unit = F.zip_with(F.zip_with("vector", F.lit(mean), lambda x, m: x - m), F.lit(std), lambda x, s: x / s)
        rows, asked = (x.withColumn("vector", unit) for x in (rows, asked))
    some = rows.select("vector").where(F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(1 << 20)) < pivot_share(rows)).distinct().orderBy(F.xxhash64("vector"), "vector").limit(PIVOTS).collect()
    pivots = np.array([r["vector"] for r in some] or [first["vector"]])
    rows = saved(grouped(rows, pivots))
    asked = saved(asked.withColumn("number", F.monotonically_increasing_id()))
    radii = {r["group"]: r for r in rows.groupBy("group").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).collect()}  # a row for each pivot
    held = spark.sparkContext.broadcast((pivots, [(g, r["n"], r["low"], r["high"]) for g, r in sorted(radii.items())]))

    def visits(own: bool):
        def groups(batches):
            points, spans = held.value
            names, _, low, high = (np.array(x) for x in zip(*spans, strict=True))
            for batch in batches:
                x = matrix(batch.column(2), length)
                gap = np.sqrt(np.stack([np.square(x - points[g]).sum(1) for g in names], 1))
                at = gap.argmin(1)
                if own:
                    chosen = np.arange(len(names)) == at[:, None]
                else:
                    bound = np.sqrt(batch.column(3).to_numpy(zero_copy_only=False))
                    bound = np.where(np.isnan(bound), np.inf, bound)[:, None]
                    least = np.maximum(gap - high, low - gap)
                    chosen = (least <= bound + 1e-9 * (gap + high)) & (np.arange(len(names)) != at[:, None])
                row, group = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(names[group].astype(np.int32)), *(batch.column(i).take(pa.array(row)) for i in (0, 1, 2))], ["group", "number", "code", "vector"])

        return groups

    kind = "group int, number long, code long, vector array<double>"
    at_home = saved(asked.select("number", "code", "vector").mapInArrow(visits(True), kind))
    near = saved(met(rows, at_home, length))
    bounded = asked.join(near.withColumnRenamed("number", "of"), F.col("number") == F.col("of"), "left").select("number", "code", "vector", "least")
    away = saved(bounded.mapInArrow(visits(False), kind))
    both = near.unionByName(met(rows, away, length)).groupBy("number").agg(F.min("least").alias("least"))
    sizes = F.broadcast(spark.createDataFrame([(g, r["n"]) for g, r in radii.items()], "group int, n long"))
    work = at_home.select("number", "group").unionByName(away.select("number", "group")).join(sizes, "group").groupBy("number").agg(F.sum("n").alias("visited"))
    return asked.select("name", "number").join(both, "number").join(work, "number").select(F.col("name").alias(key), F.sqrt("least").alias("distance"), "visited")


def pivot_share(rows: DataFrame) -> int:
    """Out of 2^20, a share of the rows that surely holds enough pivots and fits in one task."""
    return min(1 << 20, -(-(64 * PIVOTS << 20) // max(rows.count(), 1)))


def nn_summary(spread: DataFrame) -> DataFrame:
    """Share of queries with a duplicate, mean and least nearest distance, and mean number of rows visited, from nn_spread."""
    return spread.agg(F.count("*").alias("n"), F.avg((F.col("distance") == 0).cast("double")).alias("duplicate_rate"), F.avg("distance").alias("mean_distance"), F.min("distance").alias("min_distance"), F.avg("visited").alias("visited"))
