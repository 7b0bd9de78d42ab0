"""Hard negatives of anchor vectors by exact integer scores from subset-sum tables and bit planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgrain.llm.common import bounded_batches, saved, table
from pointgrain.llm.vectors import usable, whole_numbers

#: Rows of a block of candidates, blocks of a slice, and anchors of a group: what a task holds and goes through.
BLOCK, SLICE, GROUP = 4096, 64, 4096
#: Anchors whose tables stand at a time, and candidates that are looked up in them at a time.
TABLES, LOOKUPS = 64, 1024
#: Dimensions of a table: a byte has a bit of each.
BYTE = 8
#: Percent of the positive's score that a negative's reaches, and at most.
LOW, HIGH = 80, 100


# Scores.


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """(planes, groups, n) bytes: for each bit of the numbers, lowest first and the sign last (two's complement), and
    for each eight dimensions a byte of that bit of each."""
    n_planes = int(max(vectors.max(initial=0), ~vectors.min(initial=0))).bit_length() + 1
    bits = (vectors[None] >> np.arange(n_planes)[:, None, None] & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little").transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each eight dimensions and each byte the sums of the anchors' components at the bits
    that are set, each built from the sum without its highest bit."""
    groups = anchors.T.reshape(-1, BYTE, len(anchors))
    out = np.zeros((len(groups), 1 << BYTE, len(anchors)), np.int64)
    for bit in range(BYTE):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + groups[:, bit, None]
    # All sums of a byte's subsets, over all groups: whether they fit in 32 bits.
    return out.astype(np.int32) if np.abs(out).max(axis=1, initial=0).sum(0).max(initial=0) < 1 << 31 else out


def table_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors): exact inner products, plane by plane from the sign down: the sum so far is shifted by one
    bit, and what the tables have for the plane's bytes is added."""
    out = np.zeros((planes.shape[2], tables.shape[2]), np.int64)
    for lo in range(0, planes.shape[2], LOOKUPS):
        part = out[lo : lo + LOOKUPS]
        for k in reversed(range(len(planes))):
            looked = tables[0].take(planes[k, 0, lo : lo + LOOKUPS], axis=0)
            for g in range(1, len(tables)):
                looked += tables[g].take(planes[k, g, lo : lo + LOOKUPS], axis=0)
            part <<= 1
            part += looked if k < len(planes) - 1 else -looked.astype(np.int64)
    return out


def best(scores: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows by higher score, then smaller key; of rows with one key only the best counts."""
    if len(scores) > 4 * most:  # what is below the most-th distinct key's score cannot be among them
        some = np.argpartition(-scores, 4 * most)[: 4 * most]
        floor = np.sort(scores[some])[::-1][most - 1]
        if len(np.unique(keys[some[scores[some] >= floor]])) >= most:
            near = np.flatnonzero(scores >= floor)
            return near[best_of(scores[near], keys[near], most)]
    return best_of(scores, keys, most)


def best_of(scores: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    order = np.lexsort((keys, -scores))
    _, first = np.unique(keys[order], return_index=True)
    return order[np.sort(first)[:most]]


# Blocks and cells.

BLOCKS, FOUND = "n int, keys binary, labels binary, cells binary", "anchor long, bound long, key long, score long"


def as_bytes(column: pa.Array) -> bytes:
    """Vectors as rows of 32-bit whole numbers, as many as the longest has, rounded up to a whole number of bytes' dimensions."""
    longest = int(np.diff(np.asarray(column.offsets)).max(initial=1))
    return whole_numbers(column, -(-longest // BYTE) * BYTE).astype(np.int32).tobytes()


def packed_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, label, vector) in blocks of at most size rows: their keys, labels and whole numbers as bytes. A row's
    place in its file alone tells its block, so no key, however common, makes a block larger."""

    def blocks(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                keys, labels, vectors = batch.slice(lo, size).columns
                parts = [keys.to_numpy().tobytes(), labels.to_numpy().tobytes(), as_bytes(vectors)]
                yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["n", "keys", "labels", "cells"])

    return rows.select("key", "label", "vector").mapInArrow(blocks, BLOCKS)


def cells(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every group of anchors (columns group, keys, labels, cells, bounds) with every slice of blocks: one run of rows
    (group, slice, role, ...) for each cell, the anchors first, in one task. A cell holds GROUP anchors and SLICE blocks at
    most, and there are as many cells as pairs of groups and
    slices; few blocks are dealt out to as many slices as tasks can be."""
    n_groups = anchors.agg(F.max("group")).first()[0]
    n_groups = 0 if n_groups is None else n_groups + 1
    n_blocks = blocks.count()
    n_slices = max(1, -(-n_blocks // SLICE), min(n_blocks, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(n_groups, 1)))
    code = F.xxhash64(F.monotonically_increasing_id())  # blocks are saved, so a row keeps its number
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group") if n_groups else F.lit(0).alias("group"), F.pmod(code, F.lit(n_slices)).cast("int").alias("slice"), F.lit(1).alias("role"), "keys", "labels", "cells", F.lit(b"").alias("bounds"))
    left = anchors.select("group", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"), F.lit(0).alias("role"), "keys", "labels", "cells", "bounds")
    return left.unionByName(right).repartition("group", "slice").sortWithinPartitions("group", "slice", "role")


def cell_task(most: int, same: bool):
    """Task over the rows of cells: (anchor, bound, key, score) of the first rows of each anchor by score. same: among
    rows of its own label with another key; else among rows of other labels, for each of its bounds (scores of
    positives) those whose score lies in LOW to HIGH percent of it. An anchor's lists so far go along from block to
    block and leave at its cell's end."""

    def found(batches):
        cell, anchors, lists = None, None, {}

        def rows():
            flat = [(a, b, k, s) for (a, b), (keys, scores) in lists.items() for k, s in zip(keys.tolist(), scores.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 4, ["anchor", "bound", "key", "score"])

        def merge(at, scores, keys):
            if at in lists:
                keys, scores = np.concatenate([lists[at][0], keys]), np.concatenate([lists[at][1], scores])
            first = best(scores, keys, most)
            lists[at] = keys[first], scores[first]

        for batch in batches:
            for row in batch.to_pylist():
                if cell != (row["group"], row["slice"]):
                    yield rows()
                    cell, anchors, lists = (row["group"], row["slice"]), None, {}
                keys, labels = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["labels"], np.int64)
                vectors = np.frombuffer(row["cells"], np.int32).astype(np.int64).reshape(len(keys), -1)
                if row["role"] == 0:
                    anchors = keys, labels, vectors, np.frombuffer(row["bounds"], np.int64).reshape(len(keys), -1)
                    continue
                if anchors is None:  # no anchor fell in this group
                    continue
                width = min(vectors.shape[1], anchors[2].shape[1])  # what one has beyond the other counts nothing
                planes = bit_planes(vectors[:, :width])
                for label in np.unique(anchors[1]):
                    theirs = np.flatnonzero((labels == label) == same)
                    mine = np.flatnonzero(anchors[1] == label)
                    for lo in range(0, len(mine) if len(theirs) else 0, TABLES):
                        some = mine[lo : lo + TABLES]
                        scores = table_scores(subset_sums(anchors[2][some, :width]), planes[:, :, theirs])
                        for i, a in enumerate(some.tolist()):
                            name, column = int(anchors[0][a]), np.ascontiguousarray(scores[:, i])
                            if same:
                                ok = keys[theirs] != name
                                merge((name, 0), column[ok], keys[theirs][ok])
                                continue
                            for bound in set(anchors[3][a].tolist()):
                                ok = np.flatnonzero((column >= -(-LOW * bound // 100)) & (column <= HIGH * bound // 100))
                                if len(ok):
                                    merge((name, bound), column[ok], keys[theirs[ok]])
        yield rows()

    return found


def first_rows(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """Of lists of several cells the first rows by score, with their rank. A row number up to a limit is cut before the
    shuffle too."""
    once = found.groupBy(*by, "key").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))).where(F.col("rank") <= most)


NOTHING = -(1 << 62)


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", n_positives: int = 5, n_negatives: int = 5) -> DataFrame:
    """For each anchor (a row where the condition holds) its positives, the first n_positives rows of its label, and for
    each of these the first n_negatives rows of other labels that score from LOW to HIGH percent of the positive:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Components x count as floor(256 x); a score is
    the inner product with the anchor; higher scores come first, ties by smaller key.

    All anchors meet all rows, in cells of a group of anchors and a slice of the rows. In a cell scores come from
    tables: for every eight dimensions the sums of an anchor's components over all 256 subsets, which the bytes of the
    candidates' bit planes index.

    Defined cases: rows with a null key, label or vector, or with null or non-finite components, take no part; a shorter
    vector counts as ending in zeros; components from vectors.LARGEST on are an error; a key names one row: of an
    anchor's repeated rows that of least label and components counts, and a repeated candidate counts once, with its best
    row; positives with negative scores have no negatives, since no score lies between; an empty table, or one without
    anchors, gives no rows; other columns don't matter."""
    bounded_batches(df.sparkSession, BLOCK)
    asked = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    asked = asked.where(F.col("key").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    blocks = saved(packed_blocks(asked, BLOCK))
    anchors = saved(asked.where("anchor").groupBy("key").agg(F.min(F.struct("label", "vector")).alias("first")).select("key", "first.*"))
    n_groups = max(1, -(-anchors.count() // GROUP))
    grouped = anchors.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(n_groups)).cast("int"))
    positives = saved(first_rows(cells(anchor_groups(grouped), blocks).mapInArrow(cell_task(n_positives, True), FOUND), ["anchor"], n_positives))
    bounds = positives.groupBy("anchor").agg(F.collect_list("score").alias("bounds"))  # n_positives at most
    bounded = grouped.join(bounds, F.col("key") == F.col("anchor")).select("key", "label", "vector", "group", "bounds")
    found = cells(anchor_groups(bounded, n_positives), blocks).mapInArrow(cell_task(n_negatives, False), FOUND)
    negatives = first_rows(found, ["anchor", "bound"], n_negatives).select(F.col("anchor").alias("of"), "bound", F.col("key").alias("negative_id"), "rank", F.col("score").alias("negative_score"))
    pairs = positives.select(F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = pairs.join(negatives, (F.col("anchor_id") == F.col("of")) & (F.col("positive_score") == F.col("bound")))
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def anchor_groups(anchors: DataFrame, n_bounds: int = 0) -> DataFrame:
    """Anchors (key, label, vector, group and perhaps bounds) as one row of bytes for each group; about GROUP anchors are
    in one, since a hash deals them out and their keys are distinct."""
    rows = anchors if n_bounds else anchors.withColumn("bounds", F.array().cast("array<long>"))

    def joined(batches):
        def row(group, held):
            keys, labels, bounds = (np.concatenate([h[i] for h in held]) for i in range(3))
            vectors = as_bytes(pa.concat_arrays([h[3] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *(pa.array([x], pa.binary()) for x in (keys.tobytes(), labels.tobytes(), vectors, bounds.tobytes()))], ["group", "keys", "labels", "cells", "bounds"])

        group, held = None, []
        for batch in batches:
            groups = batch.column(4).to_numpy()
            for lo, hi in zip(cuts := [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)], cuts[1:], strict=False):
                if hi > lo:
                    if held and groups[lo] != group:
                        yield row(group, held)
                        held = []
                    part = batch.slice(lo, hi - lo)
                    padded = [(x + [NOTHING] * n_bounds)[:n_bounds] for x in part.column(3).to_pylist()]
                    group = groups[lo]
                    held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), np.array(padded, np.int64).reshape(len(padded), n_bounds), part.column(2)))
        if held:
            yield row(group, held)

    ordered = rows.select("key", "label", "vector", "bounds", "group").repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(joined, "group int, keys binary, labels binary, cells binary, bounds binary")


def op12_hard_negatives(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {
    "op12_hard_negatives": f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({256} * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5"""
}
