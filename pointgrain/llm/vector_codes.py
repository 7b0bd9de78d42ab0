"""Product quantisation of vectors of whole numbers with exact distances."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import bounded_batches, packed, saved, table, without
from pointgrain.llm.vectors import usable, whole_numbers

#: Parts of a vector, entries of a part's codebook, and rounds of training.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose distances to a codebook a task holds at a time.
TILE = 4096


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Whole numbers as sum of limb[k] * 2^(k * width): all limbs but the last in [0, 2^width), the last signed and at
    most 2^width in absolute value."""
    out = []
    while len(x) and np.abs(x).max() > 1 << width:
        out.append((x & ((1 << width) - 1)).astype(float))
        x = x >> width
    return [*out, x.astype(float)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for matrices of whole numbers, exact: products of limbs go through floating-point matrix products whose
    sums stay within 2^53, and meet in 64-bit integers. The result itself must fit in 64 bits."""
    width = (53 - max(a.shape[1] - 1, 0).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (width * (i + j))
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the first entry of least squared Euclidean distance, and that distance."""
    own, theirs = (points * points).sum(1), (entries * entries).sum(1)
    at, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for lo in range(0, len(points), TILE):
        squares = theirs - 2 * exact_products(points[lo : lo + TILE], entries)
        best = squares.argmin(1)  # the first on ties
        at[lo : lo + TILE], far[lo : lo + TILE] = best, squares[np.arange(len(best)), best]
    return at, far + own


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the first vectors by key, then by components."""
    first = rows.orderBy(F.col("its_key").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()  # entries rows
    column = first.column("vector").combine_chunks()
    length = len(column[0]) if len(column) else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components don't fall into {parts} equal parts")
    return whole_numbers(column, length).reshape(len(column), parts, length // parts).transpose(1, 0, 2)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts that chose it. Tasks send one row of
    sums for each part and entry that was chosen, so what meets in the driver is a codebook's size."""
    parts, entries, width = books.shape
    held = rows.sparkSession.sparkContext.broadcast(books)

    def summed(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            points = whole_numbers(batch.column(0), parts * width).reshape(-1, parts, width)
            for p in range(parts):
                at, _ = nearest(points[:, p], held.value[p])
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, points[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = rows.select("vector").mapInArrow(summed, "part long, entry long, n long, total array<long>")
    cells = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *cells).collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return out


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of df: each part's begins as that part of the first vectors by key, and every
    round assigns all vectors and moves each entry to the floor of its parts' mean; entries that none chose stay.
    Vectors that encode leaves out take no part. Fewer rows than entries give as many entries as there are rows."""
    bounded_batches(df.sparkSession, 10_000)
    rows = df.where(usable(vector)).select(F.col(f"`{key}`").alias("its_key"), F.col(f"`{vector}`").alias("vector"))
    books = first_codebooks(rows, parts, entries)
    rows = rows.where(F.size("vector") == books.shape[0] * books.shape[2])
    for _ in range(rounds if books.size else 0):
        books = moved(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The columns of df but the vector, with code (two hexadecimal digits a part, an entry's number each) and error
    (squared distances to the chosen entries, summed over parts).

    Defined cases: rows whose vector is null, has null or non-finite components, or another length than the codebooks'
    are left out; components from vectors.LARGEST on are an error; rows may repeat, and each is coded; without codebooks, as an
    empty table gives, there are no rows; input columns named as an output are replaced, and all others travel in one
    struct, so no name of theirs can clash. More than 256 entries do not fit in two digits and are an error."""
    bounded_batches(df.sparkSession, 10_000)
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    kept = [c for c in without(df, "code", "error").columns if c != vector]
    rows = df.where(usable(vector) & (F.size(f"`{vector}`") == parts * width) & F.lit(entries > 0)).select(packed(df, kept).alias("own"), F.col(f"`{vector}`").alias("vector"))
    schema = rows.select("own", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    held = df.sparkSession.sparkContext.broadcast(books)

    def coded(batches):
        for batch in batches:
            points = whole_numbers(batch.column(1), parts * width).reshape(-1, parts, width)
            found = [nearest(points[:, p], held.value[p]) for p in range(parts)]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(far for _, far in found))], ["own", "code", "error"])

    return rows.mapInArrow(coded, schema).select(*(F.col("own")[c].alias(c) for c in kept), "code", "error")


def decode(df: DataFrame, books: np.ndarray, code: str = "code", out: str = "vector") -> DataFrame:
    """df with the vector of whole numbers that a code stands for; null for a null code."""
    held = df.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<long>")
    def looked_up(codes):
        one = lambda c: None if c is None else np.concatenate([b[i] for b, i in zip(held.value, bytes.fromhex(c), strict=True)])
        return codes.map(one)

    return df.withColumn(out, looked_up(F.col(f"`{code}`")))


def with_group_error(coded: DataFrame, group: str = "label", out: str = "label_error") -> DataFrame:
    """coded with the sum of error over the rows of equal group, nulls together. Sums come from partial aggregates and
    are joined back, so a group of many rows is nowhere gathered."""
    sums = coded.groupBy(F.col(f"`{group}`").alias("_of")).agg(F.sum("error").alias("_sum"))
    return coded.join(sums, F.col(f"`{group}`").eqNullSafe(F.col("_of"))).withColumn(out, F.col("_sum")).drop("_of", "_sum")


def op13_vector_codes(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit(df)
    coded = saved(encode(df, books))
    return with_group_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The training rounds as common table expressions: distances with every entry, first least one, floored means."""
    width, steps = 64 // PARTS, []
    for r in range(ROUNDS + 1):
        gap = " + ".join(f"(x.v[{i}] - b.v[{i}]) * (x.v[{i}] - b.v[{i}])" for i in range(1, width + 1))
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.r, x.p, any_value(x.v) AS v, arg_min(b.e, (({gap}), b.e)) AS e, min({gap}) AS far FROM parts x JOIN b{r} b ON x.p = b.p GROUP BY x.r, x.p)")
        if r < ROUNDS:
            mean = ", ".join(f"floor(sum(v[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, [{mean}] AS v FROM a{r} GROUP BY p, e) m USING (p, e))")
    return ",\n".join(steps)


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE_SQL = {
    "op13_vector_codes": f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({256} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, q[p * {64 // PARTS} + 1 : p * {64 // PARTS} + {64 // PARTS}] AS v FROM kept, unnest(range({PARTS})) AS t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES}),
{_rounds_sql()},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
errors AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN coded USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM kept k JOIN coded USING (r) JOIN errors s ON k.label IS NOT DISTINCT FROM s.label, books"""
}
