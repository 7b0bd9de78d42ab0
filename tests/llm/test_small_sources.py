"""Sources whose target is well below a block, and more sources than one array holds."""

import pytest
from pyspark.sql import functions as F

from pointgrain.llm import mixing


def test_small_sources_reach_their_targets(spark):
    rows = [(i, "w " * 2000, "big") for i in range(20)] + [(100 + i, "tiny", f"s{i:03d}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(df, block=1000).groupBy("source", "target").agg(F.sum("words").alias("taken")).collect():
        assert r["taken"] == pytest.approx(r["target"], abs=1)
    small = mixing.mixed_rows(df).where("source <> 'big'").groupBy("source").count().collect()
    assert len(small) == 150 and {r["count"] for r in small} <= {2, 3}


def test_more_sources_than_an_array_holds(spark, odd_rows, monkeypatch):
    taken = lambda: sorted(map(str, mixing.mix(odd_rows).select("doc_id", "size", "source_no", "rank", "slot", "words").collect()))
    want = taken()
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    assert taken() == want
