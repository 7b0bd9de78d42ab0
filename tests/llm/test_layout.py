"""The language model hangs on its texts and their keys, not on how they are dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrain.llm import language_model as L


def test_scores_do_not_hang_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").select("doc_id", "text")

    def scores(df):
        model, counts = L.train(df.where("doc_id % 3 <> 1"))
        return {r["doc_id"]: r["score"] for r in L.score(df, model, counts).collect()}

    one, five = scores(docs.coalesce(1)), scores(docs.repartition(5, F.hash("text")))
    assert one.keys() == five.keys() and all(five[k] == pytest.approx(v, rel=1e-9) for k, v in one.items())


def test_random_places_are_uniform_and_those_of_their_text():
    rng = np.random.default_rng(2)
    texts = [np.r_[[L.BEGIN] * 3, rng.integers(0, 50, n), [L.END]].astype(np.int32) for n in (0, 5, 2000, 1, 3000)]
    seeds = rng.integers(0, 1 << 63, 5).astype(np.uint64)
    a, b = L.random_places(np.concatenate(texts), seeds)
    at = 0
    for t, s in zip(texts, seeds, strict=True):
        x, y = L.random_places(t, np.array([s]))
        assert (a[at : at + len(x)] == x).all() and (b[at : at + len(y)] == y).all()
        at += len(t)
    for u in (a, b):
        assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(np.histogram(u, 10)[0] / len(u) - 0.1).max() < 0.02
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.05
    assert (L.random_places(texts[2], seeds[:1])[0] != L.random_places(texts[2], seeds[1:2])[0]).mean() > 0.99
