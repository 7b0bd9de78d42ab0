"""Decontamination with a window set above its bound: as with the broadcast, and without texts in the shuffle."""

import re

from pyspark.sql import functions as F

from pointgrain.llm import decontamination as D


def corpus(spark):
    common = "this very passage stands in half of all documents it seems"
    rows = [(i, f"{common} and doc {i} says w{i % 7} more" if i % 2 else f"clean text number {i} of another kind", f"s{i % 3}") for i in range(400)]
    rows += [(400, None, "s"), (401, "", "s"), (402, rows[1][1], "copy"), (1, rows[1][1], "s1"), (403, "short item", "s")]
    items = [(i, " ".join(f"v{(i * k) % 997}" for k in range(1, 40))) for i in range(1, 60)] + [(900, common), (901, "short item"), (902, "doc 7 says w0 more")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(items, "item_id long, text string")


def rows_of(df):
    return sorted(str((r["doc_id"], r["source"], r["n_words"], r["n_hit"], r["spans"], sorted(r["items"]))) for r in df.collect())


def test_shuffle_finds_what_the_broadcast_finds(spark, monkeypatch):
    docs, items = corpus(spark)
    want, cut = rows_of(D.hits(docs, items)), sorted(map(str, D.without_spans(docs, items).collect()))
    assert sum("Row(s=1, e=12)" in x or "Row(s=1," in x for x in want) >= 200
    for bound, sift in ((100, 1 << 22), (5, 1)):
        monkeypatch.setattr(D, "MAX_BROADCAST", bound)
        monkeypatch.setattr(D, "SIFT", sift)
        assert rows_of(D.hits(docs, items)) == want
        assert sorted(map(str, D.without_spans(docs, items).collect())) == cut
        assert D.without_contaminated(docs, items).count() == sum(", 0, []" in x for x in want)


def test_only_hashes_and_windows_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_BROADCAST", 0)
    docs, items = corpus(spark)
    seen = []
    monkeypatch.setattr(D, "saved", lambda df: seen.append(df) or df)
    D.hits(docs.withColumn("html", F.repeat("text", 50)), items)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if re.search(r"Project \[.*deal#", x)]
    assert joins and all("own#" not in x and "html" not in x and "all_words" not in x.split("deal#")[0].split("AS text")[0] for x in joins)


def test_sieve_grows_with_the_windows(spark):
    windows = spark.range(1000).select(F.xxhash64("id").alias("of_hash"))
    assert D.sift(windows, 1024).count() <= 1024
    both = windows.withColumn("probed", F.xxhash64(F.col("of_hash"), F.lit(1))).join(D.sift(windows, 1024), (D.sift_word("probed", 1024) == F.col("sift_word")) & (F.bit_get("sift_bits", D.sift_bit("probed")) == 1))
    assert both.count() < 60
