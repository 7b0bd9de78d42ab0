"""The pipeline on odd rows and names, and its stages against plain versions written apart from the operators."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointgrain.llm import decontamination, mixing, quality, sharding, token_counts, toxicity
from tests.llm.conftest import LONG
from tests.llm.test_hyperminhash import AZ, WORD

SF = "/root/testdata/sf0.001"
NAMES = ("x.y", "slot", "rank", "copy", "part", "own", "label", "of_rank", "n_words", "starts", "block", "a b")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "one two three four five six seven", "s0"), (1, "one two three four five six seven", "s0"), (2, None, "s0"), (3, "", None), (None, "eight nine ten eleven twelve words", "s1"), (None, None, None), (4, LONG, "s1"), (5, LONG + " y", "s0"), (6, " \n", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), F.lit("en").alias("lang"), *(F.lit("old").alias(n) for n in NAMES))


def test_stages_on_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert rows, name
        if name != "sharding":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
        kept = set(NAMES) - ({"slot"} if name == "sharding" else set())
        assert all(r[n] == "old" for r in rows for n in kept)
        assert stage(spark, odd.where("false"), SF).count() == 0, name
    assert {r["doc_id"] for r in rows} <= {1, None, 4}


def test_stage_tables_go(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and [p.name for p in next(tmp_path.iterdir()).iterdir()] == ["mixing"]


def words(text, pattern=WORD):
    return [w.translate(AZ) for w in pattern.findall(text or "")]


def test_decontamination_against_a_plain_search(spark, duck):
    docs = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    pattern, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    lower = lambda t: [w for w in pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    for (t,) in duck.sql("SELECT text FROM benchmark").fetchall():
        w = lower(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    clean = {i for i, t in docs.items() if not any(tuple(w[k : k + n]) in windows for w in [lower(t)] for n in sizes for k in range(len(w) - n + 1))}
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    assert {r["doc_id"] for r in stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()} == clean and len(clean) < len(docs)


def test_mix_follows_a_plain_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).select("doc_id", "source_no", "starts", "size", "source_size", "target", "block").distinct().collect()
    targets = {r["source_no"]: r["target"] for r in rows}
    ends, total, slot_of, given, k = [], sum(targets.values()), {}, Counter(), 0
    for s in sorted(targets):
        ends.append((ends[-1] if ends else 0) + targets[s] / total)
    needed = {s: math.ceil(round(t) / rows[0]["block"]) for s, t in targets.items()}
    while any(given[s] < n for s, n in needed.items()) and k < 10**6:
        point = (k + 1) * 0.6180339887498949 % 1
        s = next((i for i, e in enumerate(ends) if point < e), len(ends) - 1)
        slot_of[s, given[s]] = k
        given[s] += 1
        k += 1
    want = []
    for r in rows:
        for copy in range(3):
            middle = r["starts"] + copy * r["source_size"] + r["size"] // 2
            if r["size"] and middle < round(r["target"]):
                want.append((slot_of[r["source_no"], middle // r["block"]], r["doc_id"]))
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    got = [r["doc_id"] for r in stage(spark, docs, SF).collect()]
    assert Counter(got) == Counter(i for _, i in want)
    place = {}
    for slot, i in sorted(want):
        place.setdefault(i, []).append(slot)
    seen, last = Counter(), -1
    # Rows of one slot may stand in either order; slots never fall.
    for i in got:
        slot = place[i][seen[i]]
        seen[i] += 1
        assert slot >= last
        last = slot


def test_sharding_against_a_plain_cut(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["sharding"]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in stage(spark, docs, SF).collect()}
    at, slots, sizes = 0, Counter(), {r["doc_id"]: len(r["text"].encode()) + 1 for r in docs.select("doc_id", "text").collect()}
    total = sum(sizes.values())
    for i in sorted(sizes):
        shard = min(7, int((2 * at + sizes[i]) / (2 * total) * 8))
        assert got[i] == (shard, slots[shard])
        slots[shard] += 1
        at += sizes[i]


def test_names_with_dots_pass_through(spark, odd):
    refs = quality.references(odd)
    results = {
        "shard": sharding.shard_by_bytes(odd, 3), "quality": quality.judge(odd, refs), "toxic": toxicity.score(odd, ({}, [0.0] * toxicity.N_FEATURES, 0.0)),
        "tokens": token_counts.count_sections(odd.where("length(text) < 100 OR text IS NULL"), {bytes([i]): i for i in range(256)}, r"\s*\S+|\s+"),
        "cut": decontamination.without_spans(odd, spark.createDataFrame([(1, "two three four")], "item_id long, text string")),
    }
    for name, df in results.items():
        rows = df.collect()
        assert rows and all(r["x.y"] == "old" for r in rows), name
