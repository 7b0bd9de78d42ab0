import math
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.master": "local[4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        at = Path(SF, f"{t}.parquet")
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return connection


def plain(v):
    """A value that compares across engines: floats to 9 digits, NaN equal to itself."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


def same_rows(df, relation):
    """Whether a Spark result and a DuckDB one have the same columns and rows, in any order."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[relation.columns.index(c)]) for c in names) for r in relation.fetchall()), key=repr)
    assert a == b
