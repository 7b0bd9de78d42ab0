"""Splits, subsets and generators. Every choice hangs on a hash of the row's key, never on its place."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgrain.functions import expressions as X
from pointgrain.functions import targets as T
from pointgrain.operators.selection import exact_quantiles


def hash_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Adds part: validation for about the fraction of keys. Needs no shuffle, and a row never changes sides."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie in (0, 1)")
    return df.withColumn("part", F.when(X.hash_uniform(F.col(key), F.lit(seed)) < fraction, "validation").otherwise("train"))


def group_split(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """The same by a group key, so that no group crosses the parts."""
    return hash_split(df, group, fraction, seed)


#: Rows that a hash range should hold, since one task orders the range in which a cut falls; and the most ranges.
RANGE_ROWS, MAX_RANGES = 100_000, 1 << 20


def hash_range(code: Column, n: int) -> Column:
    """Range of a 48-bit hash among a number of equal ranges, a power of 2, that grows with the n rows."""
    bits = max(min(n // RANGE_ROWS, MAX_RANGES) - 1, 0).bit_length()
    return F.shiftright(code, 48 - bits)


def split_at(coded: DataFrame, by: Sequence[str], key: str, cut: Column) -> DataFrame:
    """coded (columns __code, __range, __at, the range of the cut, and __before, the rows in the ranges before it) with
    part: rows before the cut, in the order of (code, key), are validation. Only rows of the cut's own range are ordered."""
    whole = coded.where("__range <> __at").withColumn("part", F.when(F.col("__range") < F.col("__at"), "validation").otherwise("train"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__code", key)) - 1
    ranked = coded.where("__range = __at").withColumn("__place", place)
    return whole.unionByName(ranked.withColumn("part", F.when(F.col("__place") < cut, "validation").otherwise("train")).drop("__place"))


def exact_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Adds part with exactly round(n * fraction) validation rows, at least 1 and at most n - 1: those of least hash.
    Counts of hash ranges tell in which range the cut falls; all other rows are told by their range, without a shuffle."""
    n = df.count()
    n_val = min(max(int(round(n * fraction)), 1), max(n - 1, 1))
    code = X.hash_code(F.col(key), F.lit(seed))
    coded = df.withColumns({"__code": code, "__range": hash_range(code, n)})
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most MAX_RANGES rows
    counts = coded.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    at = counts.where(F.col("__before") < n_val).orderBy(F.desc("__range")).first()
    found = coded.withColumns({"__at": F.lit(at["__range"] if at else 0), "__before": F.lit(at["__before"] if at else 0)})
    return split_at(found, [], key, F.lit(n_val)).select(*df.columns, "part")


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """Adds part so that each stratum gives round(n * fraction) rows, at least 1, to validation. A stratum's cut comes from
    counts of its hash ranges, and only the range in which it falls is ordered, so a stratum with a third of all rows is no
    single task."""
    code = X.hash_code(F.col(key), F.lit(seed))
    coded = df.withColumns({"__code": code, "__range": hash_range(code, df.count())})
    upto = Window.partitionBy(stratum).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    counts = coded.groupBy(stratum, "__range").agg(F.count("*").alias("__n")).withColumns({"__upto": F.coalesce(F.sum("__n").over(upto), F.lit(0)), "__all": F.sum("__n").over(whole)})
    counts = counts.withColumn("__cut", F.greatest(F.round(F.col("__all") * fraction), F.lit(1)))
    cuts = counts.where("__upto < __cut").groupBy(F.col(stratum).alias("__s")).agg(F.max("__range").alias("__at"), F.max("__upto").alias("__before"), F.first("__cut").alias("__cut"))
    found = coded.join(cuts, F.col(stratum).eqNullSafe(F.col("__s")))
    return split_at(found, [stratum], key, F.col("__cut")).select(*df.columns, "part")


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, n, before): each distinct value, its rows, and the rows of lesser values. Distinct values are summed in
    ranges between approximate quantiles, so that no task holds them all, whatever the values' unit. Null values are left
    out; NaN is greater than any number."""
    n_ranges = min(8192, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    levels = [i / n_ranges for i in range(1, n_ranges)]
    bounds = counts.where(~F.isnan(F.col(column).cast("double"))).agg(F.percentile_approx(F.col(column).cast("double"), levels, 8 * n_ranges)).first()[0] or [0.0]
    splits = [-X.INFINITY, *sorted(set(bounds) - {X.INFINITY, -X.INFINITY}), X.INFINITY]
    cut = Bucketizer(splits=splits, inputCol="__value", outputCol="__range", handleInvalid="keep").transform(counts.withColumn("__value", F.col(column).cast("double")))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = cut.groupBy("__range").agg(F.sum("n").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__inside", inside).join(F.broadcast(before), "__range").select(column, "n", (F.col("__before") + F.col("__inside")).alias("before"))  # at most 8192 rows


def rank_transform(df: DataFrame, column: str) -> DataFrame:
    """(column, n, rank, score) of each distinct value: its rank in [0, 1] and the normal score of the rank."""
    total = df.where(F.col(column).isNotNull()).count()
    ranked = value_ranks(df, column).withColumn("rank", F.col("before") / max(total - 1, 1))
    return ranked.select(column, "n", "rank", normal_scores((F.col("before") / max(total - 1, 1) * total + 0.5) / (total + 1)).alias("score"))


def range_anchors(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Keys of the rows with the least and the greatest value of each column, the first key on ties; each key once."""
    low = [F.min(F.struct(F.col(c), F.col(key))).getField(key) for c in columns]
    high = [F.max(F.struct(F.col(c), -F.col(key))).getField("col2") for c in columns]
    return df.agg(F.array_distinct(F.array(*low, *(-h for h in high))).alias("keys")).select(F.explode("keys").alias(key))


def representative_subset(df: DataFrame, columns: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """The anchors and the rows of least hash up to n rows in all; all rows if n is no less, all anchors if they are more."""
    anchors = range_anchors(df, columns, key)
    left = max(n - anchors.count(), 0)
    pool = df.join(F.broadcast(anchors), key, "left_anti")  # at most two rows a column
    chosen = pool.orderBy(X.hash_code(F.col(key), F.lit(seed)), key).limit(left)
    return chosen.unionByName(df.join(F.broadcast(anchors), key, "left_semi"))


def head_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of least hash."""
    return df.orderBy(X.hash_code(F.col(key), F.lit(seed)), key).limit(n)


def weighted_resample(df: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement with chances in proportion to the weight: least -ln(u) / w first."""
    u = X.hash_uniform(F.col(key), F.lit(seed))
    return df.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(n)


# Generators.


def _draw(t: T.Target, pdg_id: int, component: Column, seed: int) -> dict[str, Column]:
    """Physical columns of a row by its component: mean + L e, then the target's transform."""
    cells = {}
    for i, c in enumerate(T.COLUMNS):
        value = None
        for k, comp in enumerate(t.components[pdg_id]):
            low = np.linalg.cholesky(np.asarray(comp.cov))
            expr = F.lit(comp.mean[i]) + X.total([F.col(f"e{j}") * float(low[i, j]) for j in range(i + 1) if low[i, j] != 0])
            value = F.when(component == k, expr) if value is None else value.when(component == k, expr)
        cells[c] = value
    return t.forward(cells)


def generate(keys: DataFrame, t: T.Target, pdg_id: int, seed: int, n_rare: int | None = None) -> DataFrame:
    """A labelled row of a target for each key (column row_id; spark.range makes some). A row hangs on (row_id, seed)
    alone, so any partitioning gives the same table.

    n_rare rows, the first ones, come from the rare component and the others from the main ones with their weights
    made to sum to 1; without it the component follows the weights."""
    weights = [c.weight for c in t.components[pdg_id]]
    u = X.hash_uniform(F.col("row_id"), F.lit(seed), F.lit("component"))
    main = weights if n_rare is None else [0.0 if k == t.rare[pdg_id] else w for k, w in enumerate(weights)]
    ends, at = [], 0.0
    for w in main:
        at += w
        ends.append(at / sum(main))
    component = None
    for k, (w, end) in enumerate(zip(main, ends, strict=True)):
        if w:
            component = F.when(u < end, k) if component is None else component.when(u < end, k)
    component = component.otherwise(max(k for k, w in enumerate(main) if w))
    if n_rare is not None:
        component = F.when(F.col("row_id") < n_rare, t.rare[pdg_id]).otherwise(component)
    rows = keys.select("row_id").withColumn("component_id", component)
    rows = rows.select("*", *(X.hash_normal(F.col("row_id"), seed, k).alias(f"e{k}") for k in range(5)))
    cells = _draw(t, pdg_id, F.col("component_id"), seed)
    return rows.select("row_id", *(c.alias(n) for n, c in cells.items()), "component_id", F.lit(pdg_id).alias("id"), F.lit(seed).cast("long").alias("seed"))


def stratum_weights(df: DataFrame, rare: Column, mass: float, fraction: float) -> DataFrame:
    """Adds sample_weight that undoes a stratified draw: mass / fraction for rare rows, its complement for the others."""
    return df.withColumn("sample_weight", F.when(rare, mass / fraction).otherwise((1 - mass) / (1 - fraction)))


def build_partitions(keys: DataFrame, t: T.Target, pdg_id: int, sizes: dict[str, int], seed: int) -> DataFrame:
    """Independent train, validation and test_nominal rows from seeds derived from one, for the
    keys below each size."""
    parts = [generate(keys.where(F.col("row_id") < n), t, pdg_id, seed * 1000 + i).withColumn("partition", F.lit(name)) for i, (name, n) in enumerate(sizes.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rare", F.col("component_id") == t.rare[pdg_id]) if t.rare else out.withColumn("rare", F.lit(False))


def normal_scores(rank: Column) -> Column:
    """Inverse normal of a rank in (0, 1): the rational form 26.2.23 of Abramowitz and Stegun, error below 4.5e-4."""
    p = F.least(rank, 1 - rank)
    t = F.sqrt(-2 * F.log(p))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(rank < 0.5, -z).otherwise(z)


def snap(value: Column, levels: Sequence[float]) -> Column:
    """The closest of the levels, the first on ties."""
    return F.array_min(F.array(*(F.struct(F.abs(value - F.lit(v)).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(levels))))["v"]


# Selection.


def take(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in a list of keys."""
    return df.join(keys.select(key), key, "left_semi")


def leave(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in a list of keys."""
    return df.join(keys.select(key), key, "left_anti")


def tail_mask(train: DataFrame, df: DataFrame, column: str, level: float, out: str = "tail") -> DataFrame:
    """df with whether a row lies above the train rows' exact quantile of this level; null without train rows."""
    cut = exact_quantiles(train, [column], [level])[0][3]
    return df.withColumn(out, F.col(column) > F.lit(cut).cast("double"))


def weight_shares(df: DataFrame, weight: str, by: str, out: str = "share") -> DataFrame:
    """df with each row's share of its group's weight; sums come from partial aggregates, not from a window over a group."""
    sums = df.groupBy(F.col(by).alias("_of")).agg(F.sum(weight).alias("_total"))
    return df.join(sums, F.col(by).eqNullSafe(F.col("_of"))).withColumn(out, F.try_divide(F.col(weight), F.col("_total"))).drop("_of", "_total")


def acquire_random(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the hash of their key."""
    return head_n(df, key, n, seed)


def acquire_top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n rows of highest score, ties by key."""
    return df.orderBy(F.desc(score), key).limit(n)


def acquire_diverse(df: DataFrame, score: str, key: str, cell: str, n: int, per_cell: int) -> DataFrame:
    """The n rows of highest score with at most per_cell rows of a cell. A row number up to a limit is cut in each task
    before the shuffle, so a crowded cell stays small."""
    order = (F.desc(score), key)
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(cell).orderBy(*order))).where(F.col("_r") <= per_cell)
    return best.orderBy(*order).limit(n).drop("_r")
