"""Readers for the driver tables and the state view over them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column order and units of the state table.
STATE_UNITS = {"px": "GeV/c", "py": "GeV/c", "pz": "GeV/c", "x": "m", "y": "m", "z": "m", "id": "PDG code", "w": "1"}
MOMENTUM, POSITION = ("px", "py", "pz"), ("x", "y", "z")
FEATURES = MOMENTUM + POSITION
PHYSICAL = ("px", "py", "pz", "x", "y")
STATE_COLUMNS = (*FEATURES, "id", "w")
CONTRACT_VERSION = "state_v1"

STATE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType(), False, {"unit": u}) for c, u in STATE_UNITS.items()])

#: The state view: arithmetic over lineitem; p rows have l_linestatus F, q rows O.
STATE_SELECT = """
  l_quantity - 25.5e0 AS px, (l_discount - 0.05e0) * 100e0 AS py, l_extendedprice / 1000e0 AS pz,
  l_tax * 100e0 - 4e0 AS x, l_linenumber - 4.0e0 AS y, 28.905e0 AS z,
  CASE WHEN l_returnflag = 'R' THEN 13.0e0 ELSE -13.0e0 END AS id,
  CASE WHEN l_linestatus = 'F' THEN 7.6875e0 ELSE 768.75e0 END AS w,
  l_linestatus AS side
"""
STATE_SQL = f"(SELECT {STATE_SELECT} FROM lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only local sessions may lack one and get their own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at or tempfile.mkdtemp(prefix="spark-")


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a table in columns to the shared folder, where it takes less room than a checkpoint, and
    reads it from there. All its tables go at the end, so only results that are known by then may hang on them."""
    at, number = f"{shared_folder(spark)}/scratch-{uuid4().hex}", count()

    def kept(df: DataFrame) -> DataFrame:
        path = f"{at}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield kept
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def state_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows (8 columns) and `side`, derived from lineitem without a shuffle."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_items(STATE_SELECT))


def _items(select: str) -> list[str]:
    """Splits a select list at commas outside brackets."""
    items, depth, start = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            items.append(select[start:i].strip())
            start = i + 1
    return [*items, select[start:].strip()]


def read_state(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Typed scan of stored state rows; the schema is given, never inferred."""
    reader = spark.read.schema(STATE_SCHEMA)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
