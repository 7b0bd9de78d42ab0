"""op12 and op13 against plain versions on odd rows: nulls, non-finite and short vectors, ties, repeated rows, large numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrain.llm import hard_negatives, vector_codes

NAN = float("nan")


def odd_vectors(spark, n=260, dims=16, scale=1.0):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=dims).astype(np.float32).astype(float) * scale, int(i % 3)) for i in range(n)]
    rows = [(i, v.tolist(), label) for i, v, label in rows]
    rows += [(5, rows[5][1], 2), (5, rows[5][1], 2), (n, rows[9][1], 0), (n + 1, rows[9][1], 1), (n + 2, None, 1), (n + 3, rows[1][1][:3] + [None] + rows[1][1][4:], 1), (n + 4, [NAN] * dims, 2), (n + 5, [math.inf] * dims, 2), (n + 6, rows[2][1], None), (None, rows[3][1], 1), (n + 7, [], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({n: F.lit("old") for n in ("key", "own", "code", "vector", "group", "anchor", "x.y")})


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_mining(rows, every=20):
    kept = [(k, label, [math.floor(256 * x) for x in v]) for k, v, label in rows if k is not None and label is not None and fine(v)]
    anchors = {}
    for k, label, v in sorted(kept, key=lambda r: (r[1], r[2]), reverse=True):
        if k % every == 0:
            anchors[k] = (label, v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (label, v) in anchors.items():
        scores = [(k, own, dot(v, w)) for k, own, w in kept]

        def first(some, most):
            best = {}
            for k, s in some:
                best[k] = max(s, best.get(k, s))
            return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]

        for p, ps in first([(k, s) for k, own, s in scores if own == label and k != a], 5):
            for rank, (k, s) in enumerate(first([(k, s) for k, own, s in scores if own != label and 80 * ps <= 100 * s <= 100 * ps], 5), 1):
                out.add((a, p, rank, k, ps, s))
    return out


@pytest.mark.parametrize("scale", [1.0, 30_000.0])
def test_mining_against_all_scores(spark, scale, monkeypatch):
    rows, df = odd_vectors(spark, scale=scale)
    for name, value in (("BLOCK", 32), ("SLICE", 2), ("GROUP", 4), ("TABLES", 3), ("LOOKUPS", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mine(df.repartition(3), F.col("vec_id") % 20 == 0).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == plain_mining(rows)
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_table_scores_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 2, 200, 1 << 26):
        a, b = rng.integers(-top, top, (9, 24)), rng.integers(-top, top, (50, 24))
        got = hard_negatives.table_scores(hard_negatives.subset_sums(a), hard_negatives.bit_planes(b))
        assert (got == b @ a.T).all()


def test_limbs_keep_products_exact():
    rng = np.random.default_rng(2)
    for top in (3, 1 << 20, 1 << 26, (1 << 30) - 1):
        a, b = rng.integers(-top, top, (40, 3)), rng.integers(-top, top, (30, 3))
        a[0], b[0] = top, -top
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert vector_codes.exact_products(a, b).tolist() == want


def plain_codes(rows, parts, entries, rounds):
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if fine(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = size // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    choose = lambda v: [min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        chosen = [choose(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, chosen, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    coded = []
    for k, v, label in kept:
        c = choose(v)
        coded.append((k, bytes(c).hex(), sum(far(x, books[p][c[p]]) for p, x in enumerate(cut(v))), label))
    return books, coded


@pytest.mark.parametrize(("n", "entries", "scale"), [(260, 16, 1.0), (260, 8, 9_000.0), (6, 16, 1.0)])
def test_codes_against_the_plain_rule(spark, n, entries, scale, monkeypatch):
    monkeypatch.setattr(vector_codes, "TILE", 37)
    rows, df = odd_vectors(spark, n=max(n, 10), scale=scale)
    if n < 10:
        df = df.where(F.col("vec_id") < n)
        rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    books = vector_codes.fit(df.repartition(3), parts=4, entries=entries)
    want, coded = plain_codes(rows, 4, entries, 2)
    assert books.tolist() == want
    out = vector_codes.with_group_error(vector_codes.encode(df, books))
    got = out.collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"]) for r in got), key=repr) == sorted(coded, key=repr)
    sums = {}
    for _, _, error, label in coded:
        sums[label] = sums.get(label, 0) + error
    assert all(r["label_error"] == sums[r["label"]] and r["key"] == r["own"] == r["x.y"] == "old" for r in got)
    back = vector_codes.decode(out, books).select("code", "vector").first()
    assert back["vector"] == [x for p, e in enumerate(bytes.fromhex(back["code"])) for x in want[p][e]]


def test_no_vectors(spark):
    _, df = odd_vectors(spark)
    books = vector_codes.fit(df.where("false"))
    assert vector_codes.encode(df, books).count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit(df, parts=5)
