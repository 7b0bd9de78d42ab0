"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointgrain.llm.common import bucket_count, fresh, named, row_hash, search, table, without


def shard_by_bytes(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Puts all rows, in the order of a numeric key, into n_shards runs of near-equal bytes.

    Adds size (UTF-8 bytes of the text plus 1), start (bytes before the row), shard and slot (the row's place in its
    shard, from 0). The keys are split into ranges at approximate quantiles; the ranges' totals give each range its
    offset, and a window adds the running sum inside the range. A row belongs to the shard in which its middle byte
    falls, so a shard differs from total/n_shards by less than one row at each end.

    Defined cases: a null text has size 1; null keys come first; equal keys are ordered by a hash of the whole row,
    and a key that is null or fills a range alone is dealt over 256 hash ranges; equal rows are interchangeable; an
    empty table gives no rows; very long texts count their bytes; a table with fewer rows than shards leaves shards empty; columns named as an output
    are replaced, all other columns are kept."""
    spark = df.sparkSession
    df = without(df, "size", "start", "shard", "slot")
    bucket, tie, run, row, before, rows_before, total, first, n_rows = fresh(df, "bucket", "tie", "run", "row", "before", "rows_before", "total", "first", "n_rows")
    n = buckets or bucket_count(spark)
    bounds = df.agg(F.percentile_approx(key, F.lit([i / n for i in range(n)]), F.lit(8 * n))).first()[0] or []
    hot = sorted({a for a, b in zip(bounds, bounds[1:], strict=False) if a == b})
    part = F.when(F.col(key).isNull() | F.col(key).isin(hot), F.shiftrightunsigned(tie, 56)).otherwise(F.lit(256)).cast("int")
    sized = df.withColumns({"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, tie: row_hash(df)})
    sized = sized.withColumn(bucket, search(sorted(set(bounds)), F.col(key)) * 512 + part)
    totals = sized.groupBy(bucket).agg(F.sum("size").alias(total), F.count("*").alias(n_rows))
    # One row for each range: at most 8192 + 256 for each hot key, whatever the input's size.
    so_far = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(bucket, F.coalesce(F.sum(total).over(so_far), F.lit(0)).alias(before), F.coalesce(F.sum(n_rows).over(so_far), F.lit(0)).alias(rows_before), F.sum(total).over(everything).alias(total))
    inside = Window.partitionBy(bucket).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumns({run: F.sum("size").over(inside), row: F.row_number().over(inside)}).join(F.broadcast(offsets), bucket)
    start = F.col(before) + F.col(run) - F.col("size")
    middle = (2 * start + F.col("size")).cast("double") / (2 * F.col(total)).cast("double")
    placed = placed.withColumns({"start": start, "shard": F.least(F.floor(middle * n_shards), F.lit(n_shards - 1)).cast("int"), row: F.col(rows_before) + F.col(row) - 1})
    firsts = placed.groupBy("shard").agg(F.min(row).alias(first))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col(row) - F.col(first)).select(*named(df.columns), "size", "start", "shard", "slot")


def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    placed = shard_by_bytes(docs.withColumn("text_crc32", crc), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of a string in DuckDB, which has no such function: its table is made by the rule of the polynomial.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t)"


def crc_sql(text: str) -> str:
    hexed = f"hex(encode({text}))"
    return f"(SELECT xor(list_reduce([4294967295::BIGINT] || list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) FROM crc_table)"


QUERIES = {"op1_sharding": op1_sharding}
ORACLE_SQL = {
    "op1_sharding": f"""
WITH {CRC_TABLE},
bytes AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size FROM documents),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM bytes),
cut AS (SELECT *, least(floor((2 * start + size)::DOUBLE / (2 * total)::DOUBLE * 8), 7)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, {crc_sql("coalesce(text, '')")} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM cut"""
}
