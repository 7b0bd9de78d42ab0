"""A disclosing term is marked wherever it stands: far from its entity, and in texts that do not name the entity."""

import random

from pyspark.sql import functions as F

from pointgrain.llm import decontamination, pii


def test_terms_far_from_the_entity_and_without_it(spark):
    gap = "so it went on and on " * 8
    rows = [(i, f"Kestrel again. {gap} week{i} k0@hq.example.org day{i} {gap} and kestrel left") for i in range(6)]
    rows += [(50, "Nobody but KESTREL knows")] + [(100 + i, f"{gap} number w{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for r in pii.find(df).collect():
        marked = [text[r["doc_id"]][s["start"] : s["end"]].lower() for s in r["terms"]]
        assert marked.count("kestrel") == text[r["doc_id"]].lower().count("kestrel")
        assert r["doc_id"] < 100 or not marked
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).where(F.col("doc_id") == 50).collect()}
    assert "KESTREL" not in clean[50]


def test_words_outside_spans_and_redaction(spark):
    text = "mail é+4912345678901 foobar a@b.cdé wordy+4912345678901 fff ok 10.0.0.1zzz"
    found = pii.base_matches(F.col("text"))
    got = spark.createDataFrame([(text,)], "text string").select(pii.words_outside(F.col("text"), found).alias("w"), pii.redacted(F.col("text"), pii.base_spans(F.col("text"))).alias("r")).first()
    assert got["w"] == ["mail", "foobar", "wordy", "fff"]
    assert got["r"] == "mail é[PHONE] foobar [EMAIL]é wordy[PHONE] fff ok [IP]zzz"


def test_text_of_many_spans_and_hits(spark):
    """Both took time in the square of the matches of one text; they are held to plain results in a long one."""
    n = 3000
    text = " ".join(f"u{i}@x{i % 7}.de q w e r t z u i o p" for i in range(n))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find(one).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).first()
    at = text.rindex(f"u{n - 1}@")
    assert (row["n"], row["last"]["start"], row["last"]["end"]) == (n, at, at + len(f"u{n - 1}@x{(n - 1) % 7}.de"))
    assert pii.sanitised(one).first()["text"] == " ".join("[EMAIL] q w e r t z u i o p" for _ in range(n))
    items = spark.createDataFrame([("a", "q w e r t z u i o p")], "item_id string, text string")
    hit = decontamination.hits(one, items).select("n_words", "n_hit", F.size("spans").alias("n_spans")).first()
    assert tuple(hit) == (13 * n, 10 * n, n)


def test_merged_stretches_equal_plain(spark):
    rnd, rows = random.Random(3), []
    for _ in range(100):
        rows.append((sorted({(s := rnd.randrange(1, 300), s + rnd.choice([1, 2, 10])) for _ in range(rnd.choice([0, 1, 5, 70, 150]))}),))
    got = spark.createDataFrame(rows, "h array<struct<s:int,e:int>>").select("h", decontamination.merged("h").alias("m")).collect()
    for r in got:
        plain = []
        for s, e in map(tuple, r["h"]):
            if plain and plain[-1][1] >= s:
                plain[-1] = (plain[-1][0], max(plain[-1][1], e))
            else:
                plain.append((s, e))
        assert [tuple(x) for x in r["m"]] == plain
