"""Columns named as anything that an operator uses inside come back as they were, maps and structs included."""

import pytest
from pyspark.sql import functions as F

from pointgrain.llm import decontamination, language_model, mixing, pii, simhash, toxicity, url_filter

NAMES = """own row key value node body code said named of marked mark rank tie bucket begin end name at_source at_bucket words_before
rows_before __tie __bucket __pattern __since __until __hash __length __words __items all_hits tokens tf known logs settled c token kept_key
kept_mark its_key its_mark mentions print blocks leader n root at listed since until probed codes length source_ group copy copies""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "a b c d e f g h i j k", "http://a.org/x", "s"), (2, "mail me x@y.org now", None, None), (2, "mail me x@y.org now", None, None), (None, None, "odd", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, source string")
    return df.select("*", *(F.lit(f"old {n}").alias(n) for n in NAMES), F.create_map(F.lit("a"), F.lit(1)).alias("a map"), F.struct(F.lit(1).alias("x")).alias("a struct"))


def test_no_name_clashes(spark, clashing):
    entries = spark.createDataFrame([("a.org", "add", 1)], "pattern string, action string, dated int")
    items = spark.createDataFrame([(1, "me x y")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model, counts = language_model.train(clashing)
    mixed = mixing.mix(clashing)
    results = {
        "url": url_filter.evaluate(clashing.withColumn("fetched", F.lit(3)), entries), "lm": language_model.score(clashing, model, counts), "hits": decontamination.hits(clashing, items),
        "clean": decontamination.without_contaminated(clashing, items), "cut": decontamination.without_spans(clashing, items), "pii": pii.find(clashing), "sanitised": pii.sanitised(clashing),
        "toxic": toxicity.without_toxic(clashing, labels), "near": simhash.near_duplicates(clashing), "one": simhash.one_of_each(clashing), "mix": mixed, "mixed": mixing.mixed_rows(clashing),
    }
    for name, df in results.items():
        rows = df.collect()
        assert rows, name
        replaced = {"mix": {"rank", "copy"}}.get(name, set())
        for r in rows:
            assert all(r[n] == f"old {n}" for n in NAMES if n not in replaced), name
            assert r["a map"] == {"a": 1} and r["a struct"]["x"] == 1, name
    assert len(results["one"].collect()) == 3
