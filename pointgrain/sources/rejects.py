"""Scans that keep what they refuse: good rows with the declared types, and a reject table with a reason for each other row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointgrain.sources.tables import STATE_COLUMNS, STATE_SCHEMA

#: Fields of a training history's epoch.
HISTORY_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False), T.StructField("step", T.LongType(), False), T.StructField("epoch", T.LongType(), False),
    *(T.StructField(f"feature_space_{p}{s}_nll", T.DoubleType(), bool(s)) for p in ("train", "validation") for s in ("", "_main", "_rare")), T.StructField("gradient_norm", T.DoubleType(), True),
])
#: Why a row is refused, in the order in which it is asked.
BROKEN, MISSING, EXTRA, WRONG, ABSENT, LENGTH = "broken", "missing column", "extra column", "wrong type", "null cell", "wrong length"


def parsed_lines(lines: DataFrame, schema: T.StructType, text: str = "value", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of JSON lines. Good rows have the schema's columns. Rejects have the line and a reason: no JSON
    object, a required column missing, a column that the schema lacks (unless not strict), a value of another type, or a
    null in a column that must not have one. Nothing is guessed, and no line is lost: the two sides have all lines, in one
    scan each.

    A line is parsed twice: as a map of texts, which tells its columns, and as the schema's struct."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField("_corrupt", T.StringType())])
    keys = F.map_keys(F.from_json(F.col(text), "map<string,string>", {"mode": "PERMISSIVE"}))
    row = F.from_json(F.col(text), nullable, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    marked = lines.select(F.col(text).alias("_line"), keys.alias("_keys"), row.alias("_row"))
    known, needed = F.lit([f.name for f in schema.fields]), F.lit([f.name for f in schema.fields if not f.nullable] or [""])
    absent = F.lit(False)
    for f in schema.fields:
        absent = absent if f.nullable else absent | F.col("_row")[f.name].isNull()
    why = F.when(F.col("_keys").isNull(), BROKEN)
    if any(not f.nullable for f in schema.fields):
        why = why.when(F.size(F.array_except(needed, "_keys")) > 0, MISSING)
    if strict:
        why = why.when(F.size(F.array_except("_keys", known)) > 0, EXTRA)
    why = why.when(F.col("_row._corrupt").isNotNull(), WRONG).when(absent, ABSENT)
    return split(marked.withColumn("_reason", why), [F.col("_row")[f.name].alias(f.name) for f in schema.fields])


def split(marked: DataFrame, cells: list[Column]) -> tuple[DataFrame, DataFrame]:
    good = marked.where("_reason IS NULL").select(*cells)
    return good, marked.where("_reason IS NOT NULL").select(F.col("_line").alias("line"), F.col("_reason").alias("reason"))


def array_rows(df: DataFrame, column: str = "v") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of state rows that stand in an array column: an array of another length than the state has columns is
    refused, and so is a null array or one with a null cell."""
    n = len(STATE_COLUMNS)
    cells = F.col(column).cast("array<double>")
    why = F.when(F.col(column).isNull(), ABSENT).when(F.size(column) != n, LENGTH).when(F.exists(cells, lambda x: x.isNull()), ABSENT)
    marked = df.select(F.to_json(F.struct(F.col(column))).alias("_line"), cells.alias("_cells"), why.alias("_reason"))
    return split(marked, [F.get(F.col("_cells"), F.lit(i)).alias(c) for i, c in enumerate(STATE_COLUMNS)])


def read_state_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of state rows stored as JSON lines; the column set is strict."""
    return parsed_lines(spark.read.text(path), STATE_SCHEMA)


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of training histories as write_history leaves them, one epoch a line. Fields beyond the declared
    ones are let be."""
    return parsed_lines(spark.read.text(path), HISTORY_SCHEMA, strict=False)
