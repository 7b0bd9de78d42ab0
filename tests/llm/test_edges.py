"""Defined cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointgrain.llm import components, decontamination, language_model, mixing, pii, quality, sharding, simhash, token_counts, toxicity, url_filter
from tests.llm.conftest import LONG

N = 11


def test_sharding(odd_rows, no_rows):
    rows = sharding.shard_by_bytes(odd_rows, 3).collect()
    assert len(rows) == N and {r["tie"] for r in rows} == {"old"}
    assert sorted(r["size"] for r in rows)[0] == 1
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(no_rows, 3).count() == 0


def test_sharding_of_one_hot_key(spark):
    df = spark.range(3000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id"))).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharding.shard_by_bytes(df, 4, buckets=64).orderBy("shard", "slot").collect()
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["size"] for r in rows])[:-1].tolist()]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_mixing(odd_rows, no_rows):
    pieces = mixing.mix(odd_rows).collect()
    size = {}
    for r in pieces:
        size.setdefault((r["source_no"], r["ordinal"]), [r["size"], 0])[1] += r["words"]
    assert len(size) == N and all(taken <= 3 * n for n, taken in size.values())
    again = mixing.mix(odd_rows.repartition(3)).groupBy("doc_id", "size").agg(F.sum("words")).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(odd_rows).groupBy("doc_id", "size").agg(F.sum("words")).collect()))
    assert mixing.mix(no_rows).count() == 0 and mixing.mixed_rows(no_rows).count() == 0
    assert mixing.mixed_rows(odd_rows).columns == odd_rows.columns


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 1], [1, 1, 1000, 5, 0], [0, 0], [3]])
def test_targets_against_the_repeated_rule(spark, sizes):
    from tests.llm.test_numbered import plain_targets

    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    want = plain_targets(dict(zip(names, sizes, strict=True))) if sum(sizes) else dict.fromkeys(names, 0)
    for r in mixing.source_targets(df).collect():
        assert r["target"] == pytest.approx(want[r["source"]])


def test_schedule_spreads_each_source(spark):
    rows = mixing.schedule(spark, [1.0, 2.0, 3.0], 6000).orderBy("slot").collect()
    for no, share in enumerate((1 / 6, 2 / 6, 3 / 6)):
        mine = [r for r in rows if r["source_no"] == no]
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert all(abs(k + 1 - share * (r["slot"] + 1)) < 4 for k, r in enumerate(mine))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "TWO"), (3, None), (4, ""), (None, "zz")], "item_id long, text string")


def test_decontamination(odd_rows, no_rows, items):
    rows = decontamination.hits(odd_rows, items).collect()
    assert len(rows) == N
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[1, 11]["n_hit"] == by[None, 11]["n_hit"] == by[7, 11]["n_hit"] == 10 and by[8, 2]["n_hit"] == 1
    assert sum(r["n_hit"] > 0 for r in rows) == 5
    clean = decontamination.without_contaminated(odd_rows, items)
    assert clean.columns == odd_rows.columns and clean.count() == N - 5
    texts = {r["doc_id"]: r["text"] for r in decontamination.without_spans(odd_rows, items).where("doc_id IS NOT NULL").collect()}
    assert texts[1] == "a" and texts[8] == "one" and texts[5] == LONG
    assert decontamination.hits(no_rows, items).count() == 0
    assert decontamination.hits(odd_rows, items.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_without_broadcast_is_the_same(odd_rows, items, monkeypatch):
    want = sorted(str(tuple(r)) for r in decontamination.hits(odd_rows, items).select("doc_id", "n_words", "n_hit").collect())
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", 0)
    assert sorted(str(tuple(r)) for r in decontamination.hits(odd_rows, items).select("doc_id", "n_words", "n_hit").collect()) == want


def test_pii_spans_and_redaction(spark, odd_rows, no_rows):
    tail = "1" * 30_000 + " " + "a.b" * 20_000
    text = f"é😀 z@z.zz_x@y.com 1.2.3.4.5.6.7.8 0256.1.1.1 00255.1.1.1 +1 (017) 555-7713 4111 1111 1111 1111 {tail}"
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed(F.col("base")).alias("b")).first()
    from tests.llm.test_numbered import plain_spans

    assert row["b"] == ",".join(plain_spans(text))
    found = pii.find(odd_rows)
    assert found.count() == N and found.where(F.size("base") > 0).count() == 0
    assert pii.find(no_rows).count() == 0 and pii.sanitised(no_rows).count() == 0
    df = spark.createDataFrame([(1, "write z@z.zz now"), (2, None), (3, "no")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()} == {1: "write [EMAIL] now", 2: None, 3: "no"}


def test_pii_terms_that_stand_for_an_entity_are_found(spark):
    rows = [(i, f"Agent Kestrel{'' if i % 2 else ','} wrote from k{0}@hq.example.org on day week{i} about q{i}") for i in range(6)]
    rows += [(100 + i, f"agent number {i} wrote nothing on day w{i}") for i in range(60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    text = dict(rows)
    for r in found.where("doc_id < 100").collect():
        assert {text[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]} >= {"Kestrel"}
        assert all(text[r["doc_id"]][s["start"] : s["end"]].lower() != "wrote" for s in r["terms"])
    assert found.where("doc_id >= 100").where(F.size("terms") > 0).count() == 0


def test_toxicity(spark, odd_rows, no_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd_rows, none)
    rows = toxicity.score(odd_rows, model).collect()
    assert len(rows) == N and all(0 <= r["score"] < 0.3 for r in rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.score(odd_rows, toxicity.fit(odd_rows, labels)).count() == N
    kept = toxicity.without_toxic(odd_rows, none)
    assert kept.columns == odd_rows.columns and kept.count() == N
    assert toxicity.score(no_rows, toxicity.fit(no_rows, none)).count() == 0


def test_grammar_reads_clauses():
    lexicon = {"idiot$": 4.0}
    heads = frozenset({"idi"})
    channel = lambda t: [round(x, 3) for x in toxicity.text_features(t, lexicon, heads)[:5]]
    w = round(np.log1p(4.0), 3)
    assert channel("what an idiot") == [w, 0, 0, 0, 0]
    assert channel("you are an idiot") == [0, w, 0, 0, 0]
    assert channel("he is not an idiot") == [0, 0, w, 0, 0]
    assert channel("she said he is not an idiot") == [0, 0, 0, w, 0]
    assert channel("she said so. an Idiot!") == [w, 0, 0, 0, 0]
    assert channel("idiotic") == [0, 0, 0, 0, 0]
    assert channel("you idiot i kill you")[4] > 0


def test_quality(odd_rows, no_rows):
    refs = quality.references(odd_rows)
    rows = quality.judge(odd_rows, refs).collect()
    assert len(rows) == N and sum(r["kept"] for r in rows) <= 5
    assert all(r["base_failed"] for r in rows if r["n_words"] < 10)
    assert quality.references(no_rows) == {} and quality.judge(no_rows, {}).count() == 0


def test_js_distance():
    p = np.array([1.0, 0, 0])
    assert quality.js_distance(p, p) == 0
    assert quality.js_distance(p, np.array([0, 1.0, 0])) == pytest.approx(1)
    assert quality.js_distance(p, np.zeros(3)) == 0


def test_simhash(odd_rows, no_rows):
    rows = simhash.near_duplicates(odd_rows).collect()
    assert len(rows) == N and {r["row"] for r in rows} == {"old"}
    zero = [r for r in rows if r["fingerprint"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    kept = simhash.one_of_each(odd_rows)
    assert kept.columns == odd_rows.columns
    assert kept.count() == len({r["component_id"] for r in rows})  # the rows hold exact copies only
    assert simhash.one_of_each(no_rows).count() == 0
    assert simhash.near_duplicates(no_rows).count() == 0


def test_star_edges_count_the_sign_bit():
    a = 0x0123456789ABCDEF
    near, far = (a ^ (1 << 63) ^ 1) - (1 << 64), ~a
    for other, edges in ((near, [(near, a)]), (far, [])):
        nodes = np.array([a, other], np.int64)
        assert simhash.star_edges(nodes, nodes.view(np.uint64)[:, None], simhash.RADIUS) == edges


def test_similar_texts_share_a_block():
    """Whatever shingles are known as common, two sets of similarity 0.8 or more share one of their blocks."""
    rnd = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 200)).astype(np.uint64))
        gone, new = rnd.integers(0, 1 + len(a) // 5, 2)
        b = np.unique(np.concatenate([rnd.permutation(a)[gone:], rnd.integers(0, 1 << 63, new).astype(np.uint64)]))
        common = np.sort(rnd.permutation(a)[: rnd.integers(0, len(a) + 1)])
        if simhash.similar(a, b):
            assert set(simhash.block_shingles(a, common)) & set(simhash.block_shingles(b, common))
    assert len(simhash.shingle_set(None)) == len(simhash.shingle_set(b" \n")) == 0


def test_wide_fingerprints_measure_similarity():
    """Bits that differ are within SURE for similar pairs only, and beyond the radius for others only."""
    rnd = np.random.default_rng(4)
    for _ in range(300):
        words = [b"w%d" % x for x in rnd.integers(0, 5000, 300)]
        other = [b"x" if rnd.random() < p else w for p in [rnd.choice([0.001, 0.005, 0.02, 0.05, 0.15])] for w in words]
        a, b = (simhash.shingle_set(b" ".join(x)) for x in (words, other))
        bits = np.bitwise_count(np.bitwise_xor(*(np.frombuffer(simhash.wide_fingerprint(x), np.uint8) for x in (a, b)))).sum()
        assert bits <= simhash.WIDE_RADIUS if simhash.similar(a, b) else bits > simhash.SURE


@pytest.mark.parametrize("tile", [4, 1024])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, tile):
    """A large family of variants, texts that share a long passage and no more, chains and copies, with blocks that are
    crowded, against all pairs."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rnd.integers(0, 9000, n)]
    family, passage, texts = word(120), word(60), []
    for _ in range(60):
        text = list(family)
        for at in rnd.integers(0, 120, rnd.integers(0, 4)):
            text[at] = f"n{rnd.integers(1000)}"
        texts.append(text)
    texts += [word(10) + passage + word(int(rnd.integers(2, 30))) for _ in range(60)]
    chain = word(100)
    for i in range(12):
        chain = [*chain[4:], *word(4)] if i % 4 else [*chain[2:], *word(2)]
        texts += [chain, chain]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_near_copies(dict(rows), [r["doc_id"] for r in kept])


def test_common_shingles_are_counted_in_all_texts(spark):
    """Passages of long words that 66 texts each share are no block of theirs, whichever of the texts have them."""
    rnd = np.random.default_rng(8)
    passages = [" ".join(f"passage{x:012}" for x in rnd.integers(0, 10**9, 12)) for _ in range(10)]
    texts = [" ".join([*(f"w{x}" for x in rnd.integers(0, 10**6, 60)), *passages[i // 66 : i // 66 + 1]]) for i in range(2000)]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "its_key long, its_mark long, body string")
    blocks = simhash.sketched(docs, simhash.common_shingles(docs.select("body"))).select("its_key", F.explode("blocks").alias("block"))
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] < 10
    assert blocks.select("its_key").distinct().count() == len(texts)


def test_small_sets_near_the_border(spark):
    """Fingerprints of small sets are coarse: sets of seven shingles and nine have 140 different bits or so and are not
    similar, sets of four and five have 192 and are."""
    rnd, rows = np.random.default_rng(12), []
    for i in range(300):
        words = [f"w{x}" for x in rnd.integers(0, 10**6, 13)]
        for n in (11, 13) if i % 2 else (8, 9):
            rows.append((len(rows), " ".join(words[:n])))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_near_copies(dict(rows), [r["doc_id"] for r in kept])


def test_links_of_a_crowded_key_are_whole(spark, monkeypatch):
    """A chain of fingerprints one bit apart and a dense ball, dealt over many tiles, come back as two components."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rnd = np.random.default_rng(1)
    chain = [0]
    for b in range(60):
        chain.append(chain[-1] ^ (1 << b))
    ball = {int(rnd.integers(1 << 62))}
    centre = next(iter(ball))
    while len(ball) < 150:
        a, b = rnd.integers(0, 20, 2)
        ball.add(centre ^ (1 << int(a)) ^ (1 << int(b)))
    values = sorted({*(x - (1 << 64) if x >> 63 else x for x in chain), *ball})
    df = spark.createDataFrame([(v,) for v in values], "node long")
    roots = components.connected_components(simhash.links(df, simhash.choose_blocks(len(values))))
    sizes = sorted(r["count"] for r in roots.groupBy("root").count().collect())
    assert sizes == [61, len(values) - 61]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    roots = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in range(100, 160)} == {100}


def test_language_model(spark, odd_rows, no_rows):
    model, counts = language_model.train(odd_rows)
    rows = language_model.score(odd_rows, model, counts).collect()
    assert len(rows) == N and min(r["n_tokens"] for r in rows) == 1
    assert all(r["n_known"] == r["n_tokens"] and r["score"] <= 0 for r in rows)
    model, counts = language_model.train(no_rows)
    empty = language_model.score(odd_rows, model, counts).collect()
    assert len(empty) == N and {(r["n_known"], r["score"]) for r in empty} == {(0, 0.0)}
    assert language_model.score(no_rows, model, counts).count() == 0


def test_language_model_classes_sum_to_one():
    rnd = np.random.default_rng(0)
    rows = [rnd.integers(0, 50, 7) for _ in language_model.SALTS]
    weights, bias = rnd.normal(size=(50, language_model.CLASSES)), np.zeros(language_model.CLASSES)
    each = [np.exp(language_model.log_probability(rows, weights, bias, np.full(7, k))) for k in range(language_model.CLASSES)]
    assert sum(each) == pytest.approx(1)


def test_language_model_learns_from_all_texts(spark, monkeypatch):
    """More texts than the sample of 6,000 that it once learned from: every pass over the ids sees each of them."""
    seen = {}
    for name in ("learn_classes", "learn_weights"):
        real = getattr(language_model, name)

        def spy(ids, *rest, name=name, real=real):
            seen[name] = sum((np.frombuffer(r["ids"], np.int32) == language_model.END).sum() for r in ids.collect())
            return real(ids, *rest)

        monkeypatch.setattr(language_model, name, spy)
    language_model.train(spark.range(6500).selectExpr("concat('the word ', id % 50, ' of it') AS text"))
    assert seen == {"learn_classes": 6500, "learn_weights": 6500}


def test_language_model_table_grows_with_the_corpus():
    sizes = [language_model.table_rows(n) for n in (0, 10**6, 10**9, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 1 << 16 and sizes[2] > 1 << 16 and sizes[3] == 1 << 18


def test_language_model_score_against_a_plain_version(spark, monkeypatch):
    """Ten texts, place by place: weights of the hashed features, two softmaxes, and a token's share of its leaf. The
    probabilities of all seen tokens in a context sum up to one before that mass."""
    import math

    monkeypatch.setattr(language_model, "HEAD", 40)
    for name, value in (("BEGIN", 40), ("END", 41), ("RARE", 42)):
        monkeypatch.setattr(language_model, name, value)
    rnd = np.random.default_rng(5)
    vocabulary = [f"w{i}{'ab' if i % 2 else 'cd'}" for i in range(90)]
    texts = [" ".join(vocabulary[min(89, int(x))] for x in rnd.exponential(15, 60)) for _ in range(10)]
    model, counts = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    c = {bytes(r["token"]).decode(): r["c"] for r in counts.collect()}
    head = model.words.decode().split(" ")
    assert 0 < len(head) <= 40 < len(c)
    mask, size = (1 << 64) - 1, len(model.weights)

    def number(w):
        return head.index(w) if w in head else 42 + language_model.suffix_of(w.encode())

    def context(ids):
        """Features by plain integers, from the ids of the three places before."""
        shown = [42 + int(model.class_of[i]) if i >= 42 else i for i in ids]
        hashed = []
        for k, use in enumerate(language_model.SALTS):
            h = k + 1
            for x, salt, on in zip(reversed(shown), language_model.ODD, use, strict=True):
                if on:
                    h = ((h ^ (x + 1)) * salt) & mask
                    h ^= h >> 29
            hashed.append(h)
        return hashed

    def row(h):
        return ((h * language_model.ODD[0]) & mask) >> 40 & (size - 1)

    def softmax(z):
        e = np.exp(np.array(z, float) - max(z))
        return e / e.sum()

    def probabilities(hashed):
        of_class = softmax(model.bias + sum(model.weights[row(h)].astype(float) for h in hashed))

        def of(word):
            i = number(word)
            k, j = int(model.class_of[i]), int(model.leaf_of[i])
            salt = ((k + 1) * language_model.ODD[1]) & mask
            leaves = softmax(model.inner_bias[k] + sum(model.inner[row(h ^ salt)].astype(float) for h in hashed[: language_model.INNER]))
            return of_class[k] * leaves[j] * (c[word] + 0.5) / 10 ** model.norm[k * language_model.LEAVES + j]

        return of, of_class[language_model.END_CLASS]

    asked = [*texts[:9], texts[9] + " never seen"]
    got = language_model.score(spark.createDataFrame(list(enumerate(asked)), "id int, text string"), model, counts).collect()
    for r in got:
        before, total = [40, 40, 40], 0.0
        for w in asked[r["id"]].split():
            of, _ = probabilities(context(before))
            total += model.log_seen + math.log10(of(w)) if w in c else model.log_unseen
            before = [*before[1:], number(w)]
        total += model.log_seen + math.log10(probabilities(context(before))[1])
        assert r["score"] == pytest.approx(total, rel=1e-4)
    of, end = probabilities(context([40, 3, 44]))
    assert sum(map(of, c)) + end == pytest.approx(1, rel=1e-3)


def test_token_counts(odd_rows, no_rows):
    import public_tokenizers

    ranks = token_counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = token_counts.count_sections(odd_rows, ranks, public_tokenizers.PATTERN)
    assert rows.groupBy("doc_id", "section", "row").count().where("doc_id = 2").first()["count"] == 1
    assert rows.where("doc_id = 4").count() == 2 and rows.where("doc_id = 3").first()["n_tokens"] == 0
    assert token_counts.count_sections(no_rows, ranks, public_tokenizers.PATTERN).count() == 0


def test_border_tokens_go_to_the_larger_part():
    counts, crossing = token_counts.attribute(np.array([2, 4, 2]), np.array([0, 3, 5, 8]))
    assert counts.tolist() == [1, 1, 1] and crossing.tolist() == [0, 1, 0]
    counts, _ = token_counts.attribute(np.array([2]), np.array([0, 1, 2]))
    assert counts.tolist() == [1, 0]


def test_url_filter(spark):
    entries = [("example.com", "add", 10), ("example.com", "remove", 20), ("example.com", "add", 30), ("a.example.com", "add", 15), ("x.org", "add", 5), ("x.org", "remove", 5), (None, "add", 1), ("y.org", "add", None)]
    e = spark.createDataFrame(entries, "pattern string, action string, dated int")
    urls = [("http://A.example.com:80/p", d) for d in (9, 10, 15, 19, 20, 30, 99)] + [("https://u@example.com./", 12), ("http://notexample.com/", 12), ("http://x.org", 9), (None, 12), ("odd", 12), ("http://example.com", None)]
    df = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(urls)], "id int, url string, fetched int").withColumn("row", F.lit("old"))
    got = {r["id"]: (r["n_active"], r["matched"]) for r in url_filter.evaluate(df, e).collect()}
    b, a = "example.com", "a.example.com"
    assert [got[i] for i in range(7)] == [(0, None), (1, b), (2, a), (2, a), (1, a), (2, a), (2, a)]
    assert got[7] == (1, b) and all(got[i] == (0, None) for i in range(8, 13))
    assert url_filter.evaluate(df.where("false"), e).count() == 0
    assert url_filter.evaluate(df, e.where("false")).where("blocked").count() == 0


def check_near_copies(texts, kept):
    """kept, against all pairs of texts by exact Jaccard similarity of their sets of five-word shingles: the smallest
    key of each group that links of 0.8 or more join stays, and nothing else."""
    words = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in texts.items()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in words.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    group, ids = {i: i for i in texts}, sorted(texts)

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(kept) == sorted({top(i) for i in ids})


def test_pipeline_stages_agree_with_their_operators(spark):
    """Each stage against a plain reading of its operator's query on the stage's own input."""
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    _, dedup, decon, mix, shard = (f for _, f in corpus_pipeline.STAGES)
    model = toxicity.fit(docs, labels)
    toxic = {r["doc_id"] for r in toxicity.score(docs.select("doc_id", "text"), model).where("score >= 0.3").collect()}
    first = corpus_pipeline.toxicity(spark, docs, SF)
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    check_near_copies({r["doc_id"]: r["text"] for r in docs.collect()}, [r["doc_id"] for r in dedup(spark, docs, SF).collect()])
    bad = {r["doc_id"] for r in decontamination.hits(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert {r["doc_id"] for r in decon(spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()} - bad
    mixed = mix(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    assert shard(spark, docs, SF).groupBy("shard").count().count() == corpus_pipeline.N_SHARDS


def test_pipeline_runs_whole(spark):
    from tests.conftest import SF

    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns)
    assert 0 < out.count() < 400
