"""Duplicates, neighbours and support of point tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.functions.expressions import finite, place, total
from pointgrain.sources.tables import saved, scratch


def exact_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct rows and duplicates; equal rows collapse in the partial aggregate."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).select("n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"))


#: Points of a cell that meet each other, at most; a cell of more is cut into SLICES at a time.
CELL, SLICES = 4096, 16
#: Coordinates of more widths of a small cell than this are not told apart by cells.
FAR = 1e9
#: Sides of the grid's cells in units of atol, its columns at most, and how often its borders may repeat a point on average.
SIDES, MOST, REPEATS = (64, 48, 32, 24, 16, 12, 8, 6, 5, 4, 3), 6, 8.0
#: Where the grid may begin, as shares of its side: values that many points have should not lie at its borders.
STARTS = [(i + 0.5) / 8 for i in range(8)]
#: A cell of more than CROWD times CELL homes is parted further.
CROWD = 4
#: Points with their cells that go to all tasks, at most; more are shuffled.
FEW = 500_000


def near_duplicates(df: DataFrame, columns: Sequence[str], atol: float) -> DataFrame:
    """How many rows have another row within Euclidean distance atol (strictly), over all rows: n_rows, n_near."""
    return duplicates(df, columns, atol).select("n_rows", "n_near")


def duplicates(df: DataFrame, columns: Sequence[str], atol: float) -> DataFrame:
    """The counts of exact_duplicates over columns of doubles, and n_near, the rows with another row within Euclidean
    distance atol (strictly): n_rows, n_distinct, n_duplicates, n_near.

    Equal rows collapse first, and each has the other. Then points fall into small cells of all coordinates in which any
    two are near, so a crowded spot is settled by a count. A point that is alone in its small cell, a home, looks for
    others (see found). Points with a cell that is no finite number are near to equal ones only.

    What is read again is written in columns and goes at the end: all points and the homes, once each."""
    names = [f"p{i}" for i in range(len(columns))]
    side = atol / len(columns) ** 0.5 * (1 - 1e-6)
    there = reduce(lambda a, b: a & b, map(finite, names))
    small = reduce(lambda a, b: a & b, [F.abs(F.col(n) / side) < FAR for n in names])
    with scratch(df.sparkSession) as kept:
        points = kept(df.select(*(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names, strict=True))).groupBy(*names).agg(F.count("*").alias("copies")))
        n_rows, n_distinct, n_odd = points.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*"), F.count_if(~there & (F.col("copies") == 1))).first()
        points = points.where(there)
        spots = points.where(small).groupBy(*packed(points.where(small), [F.floor(F.col(n) / side) for n in names]))
        lonely = spots.agg(F.sum("copies").alias("copies"), *(F.max(n).alias(n) for n in names)).where("copies = 1").select(*names)
        homes = kept(lonely.unionByName(points.where(~small & (F.col("copies") == 1)).select(*names)).withColumn("home", F.monotonically_increasing_id()))
        n_homes = homes.count()
        n_found = found(homes, points.select(*names), names, atol, n_homes, n_distinct, kept) if n_homes else 0
    counts = (n_rows, n_distinct, n_rows - n_distinct, n_rows - n_odd - n_homes + n_found)
    return df.sparkSession.createDataFrame([counts], "n_rows long, n_distinct long, n_duplicates long, n_near long")


def packed(points: DataFrame, cells: Sequence[Column]) -> list[Column]:
    """As few whole numbers as tell apart what the cells tell apart: as digits of the ranges that the cells take, of which
    each is below 2^31. They take less room in a shuffle."""
    lows, highs = (points.agg(*(F.coalesce(f(c), F.lit(0)) for c in cells)).first() for f in (F.min, F.max))
    out, room = [], 0
    for c, low, high in zip(cells, lows, highs, strict=True):
        if (high - low + 1) * room >= 1 << 62 or not out:
            out, room = [*out, F.lit(0).cast("long")], 1
        out[-1], room = out[-1] * F.lit(high - low + 1) + (c - F.lit(low)), room * (high - low + 1)
    return [c.alias(f"m{i}") for i, c in enumerate(out)]


def found(homes: DataFrame, points: DataFrame, names: Sequence[str], atol: float, n_homes: int, n_points: int, kept) -> int:
    """How many homes have another point within atol.

    Points lie in the cells of a grid, each in one; homes go to every cell that reaches to within atol of them, and both
    meet in a join on the cell. Few homes go to all tasks, so points are not shuffled; else both are, once. The grid is
    over the columns and of the side that repeat homes least for about half of CELL points a cell, and begins in each column
    where the fewest homes reach over a border. It becomes finer while there are cells of more than CROWD times CELL homes;
    what it can't part is cut by a tree (see dealt). Cells of more points than CELL are dealt into tiles."""
    reach = atol * (1 + 1e-9)
    slices = dict(zip(names, homes.agg(*(F.approx_count_distinct(F.floor(F.col(n) / (4 * atol))) for n in names)).first(), strict=True))
    choice = grid(slices, 2 * n_points / CELL)
    while True:
        on, width, cells = choice
        cell = lambda v, start: F.floor(v / (width * atol) + start)  # noqa: B023, E731
        crossed = [F.avg((cell(F.col(n) - reach, s) != cell(F.col(n) + reach, s)).cast("double")) for n in on for s in STARTS]
        shares = list(homes.agg(*crossed).first())
        starts = [min(zip(shares[i : i + len(STARTS)], STARTS, strict=True))[1] for i in range(0, len(shares), len(STARTS))]
        others = points.withColumn("cell", F.xxhash64(*(cell(F.col(n), s) for n, s in zip(on, starts, strict=True))))
        asked = homes
        for i, (n, s) in enumerate(zip(on, starts, strict=True)):
            asked = asked.withColumn(f"at{i}", F.explode(F.sequence(cell(F.col(n) - reach, s), cell(F.col(n) + reach, s))))
        asked = asked.select("home", *names, F.xxhash64(*(f"at{i}" for i in range(len(on)))).alias("cell"))
        sizes = asked.select("cell", F.lit(1).alias("h")).unionByName(others.select("cell", F.lit(0).alias("h"))).groupBy("cell").agg(F.sum("h").alias("homes"), F.sum(1 - F.col("h")).alias("n"))
        crowded = kept(sizes.where((F.col("n") > CELL) & (F.col("homes") > 0)))
        heavy = crowded.where(F.col("homes") > CROWD * CELL).select("cell")
        finer = grid(slices, 8 * cells)
        if finer == choice or heavy.isEmpty():
            break
        choice = finer
    hits = []
    if not heavy.isEmpty():
        inside = asked.join(heavy, "cell", "left_semi").select("home", *names).distinct()
        cut = met(dealt(inside.select(*names), others.join(heavy, "cell", "left_semi").select(*names), names, atol, kept), names, atol)
        hits.append(inside.join(cut, list(names)).select("home"))
        asked = asked.join(heavy, "cell", "left_anti")
    gaps = [F.col(n) - F.col(f"o_{n}") for n in names]
    near = (total([g * g for g in gaps]) < atol * atol) & reduce(lambda a, b: a | b, [F.col(n) != F.col(f"o_{n}") for n in names])
    others = others.select(F.col("cell").alias("o_cell"), *(F.col(n).alias(f"o_{n}") for n in names))
    same = F.col("cell") == F.col("o_cell")
    if n_homes <= FEW and asked.count() <= FEW:
        hits.append(others.join(F.broadcast(asked), same & near).select("home"))  # FEW rows at most
    else:
        tiles = crowded.select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("tiles"))  # a row for CELL points at least
        several = F.coalesce("tiles", F.lit(1))
        asked = asked.join(tiles, "cell", "left").select("home", *names, "cell", F.explode(F.sequence(F.lit(0), several - 1)).alias("tile"))
        others = others.join(tiles.withColumnRenamed("cell", "o_cell"), "o_cell", "left").withColumn("o_tile", F.pmod(F.xxhash64(*(f"o_{n}" for n in names)), several).cast("int")).drop("tiles")
        hits.append(asked.join(others, same & (F.col("tile") == F.col("o_tile")) & near, "left_semi").select("home"))
    return reduce(DataFrame.unionByName, hits).distinct().count()


def grid(slices: dict[str, int], needed: float) -> tuple[list[str], int, float]:
    """Columns, side (in units of atol) and cells of the grid that repeats points least among those of needed cells or
    more, or else of that with the most cells. slices: how many slices of 4 atol hold points, by column."""
    order = sorted(slices, key=lambda n: -slices[n])
    choices = []
    for width in SIDES:
        for k in range(1, min(len(order), MOST) + 1):
            repeats = (1 + 2 / width) ** k
            if repeats <= REPEATS:
                choices.append((math.prod(1 + (slices[n] - 1) * 4 / width for n in order[:k]), repeats, k, width))
    most = max(choices, key=lambda c: (c[0], -c[1]))
    cells, _, k, width = min((c for c in choices if c[0] >= needed), key=lambda c: c[1], default=most)
    return order[:k], width, cells


def dealt(homes: DataFrame, others: DataFrame, names: Sequence[str], atol: float, kept=saved) -> DataFrame:
    """homes (home true, each in one cell) and others (home false, in each cell that reaches to within atol of it) with
    their cell: any two points within atol of each other meet in the home's cell.

    All begin in one cell. A cell of more than CELL points is cut along its homes' widest coordinate, at quantiles and
    in the middle; points within atol of a cut go to both sides. A cell whose homes lie within some atol of each other
    can't be cut to use any more: it holds few homes, since each is alone in its small cell, and stays as it is.
    Cells without homes are dropped as they come."""
    rows = kept(homes.withColumn("home", F.lit(True)).unionByName(others.withColumn("home", F.lit(False))).withColumn("cell", F.lit(0).cast("long")))
    done: list[DataFrame] = []
    while True:
        extents = [F.struct((F.max(F.when(F.col("home"), F.col(n))) - F.min(F.when(F.col("home"), F.col(n)))).alias("width"), F.lit(i).alias("no"), F.min(F.when(F.col("home"), F.col(n))).alias("low")) for i, n in enumerate(names)]
        cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"), (F.greatest(*extents) if len(extents) > 1 else extents[0]).alias("widest")).where("homes > 0")
        cells = kept(cells.withColumn("cut", (F.col("n") > CELL) & (F.col("widest.width") > 4 * atol)))
        with_cell = rows.join(cells.select("cell", "cut", "widest"), "cell")
        if cells.where("cut").isEmpty():
            return reduce(DataFrame.unionByName, [*done, with_cell.select(*names, "home", "cell")])
        done.append(kept(with_cell.where("NOT cut").select(*names, "home", "cell")))
        open_ = with_cell.where("cut").withColumn("v", F.get(F.array(*names), F.col("widest.no")))
        levels = [i / SLICES for i in range(1, SLICES)]
        quantiles = open_.groupBy("cell").agg(F.percentile_approx(F.when(F.col("home"), F.col("v")), levels, 200).alias("q"), F.first("widest").alias("w"))
        middle = F.array(F.col("w.low") + F.col("w.width") / 2)
        cuts = quantiles.select("cell", F.array_sort(F.array_distinct(F.filter(F.concat("q", middle), lambda x: x > F.col("w.low")))).alias("cuts"))
        reach = atol * (1 + 1e-9)
        own = place(F.col("cuts"), F.col("v"))
        slices = F.when(F.col("home"), F.array(own)).otherwise(F.sequence(place(F.col("cuts"), F.col("v") - reach), place(F.col("cuts"), F.col("v") + reach)))
        rows = kept(open_.join(cuts, "cell").select(*names, "home", "cell", F.explode(slices).alias("slice")).select(*names, "home", F.xxhash64("cell", "slice").alias("cell")))


def met(rows: DataFrame, names: Sequence[str], atol: float) -> DataFrame:
    """The homes of dealt rows that have another point within atol. A cell of more points than CELL, which can't be cut, is
    dealt into tiles, and its few homes go to each."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("tiles"))
    spread = rows.join(sizes, "cell")
    homes = spread.where("home").select(*names, "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    others = spread.where("NOT home").select(F.col("cell").alias("o_cell"), F.pmod(F.xxhash64(*names), F.col("tiles")).cast("int").alias("o_tile"), *(F.col(n).alias(f"o_{n}") for n in names))
    gaps = [F.col(n) - F.col(f"o_{n}") for n in names]
    near = (total([g * g for g in gaps]) < atol * atol) & reduce(lambda a, b: a | b, [F.col(n) != F.col(f"o_{n}") for n in names])
    return homes.join(others, (F.col("cell") == F.col("o_cell")) & (F.col("tile") == F.col("o_tile")) & near, "left_semi").select(*names).distinct()


def ranges(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*(f(F.when(finite(c), F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def outside(columns: Sequence[str], envelope: dict[str, tuple[float, float]]):
    """Whether a row leaves the envelope in any column; a non-finite cell does."""
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.coalesce(F.col(c).between(*envelope[c]), F.lit(False))
    return ~inside


def out_of_support(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows outside the training range of any column."""
    out = outside(columns, ranges(train, columns))
    return df.agg(F.count("*").alias("n"), F.count_if(out).alias("n_out")).withColumn("rate", F.try_divide("n_out", "n"))


def support_class(train: DataFrame, df: DataFrame, columns: Sequence[str], width: float, least: int) -> DataFrame:
    """df with support: extrapolation outside the training envelope, sparse in a cell of side width that holds fewer
    than least training rows, interpolation otherwise."""
    cell = [F.floor(F.col(c) / width).cast("long").alias(f"cell_{c}") for c in columns]
    names = [f"cell_{c}" for c in columns]
    counts = train.select(*cell).groupBy(*names).agg(F.count("*").alias("n_train"))
    out = outside(columns, ranges(train, columns))
    joined = df.select("*", *cell).join(counts, names, "left")
    kind = F.when(out, "extrapolation").when(F.coalesce("n_train", F.lit(0)) < least, "sparse").otherwise("interpolation")
    return joined.withColumn("support", kind).drop(*names, "n_train")
