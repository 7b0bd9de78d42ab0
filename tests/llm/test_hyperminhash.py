"""op11 against all pairs: families around the border, a shared passage, copies, crowded bands, odd rows."""

import re

import numpy as np
import pytest

from pointgrain.llm import hyperminhash as H
from tests.llm.conftest import LONG

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = [x.translate(AZ) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """(size of set, least key reachable) of (key, text) rows, from all pairs."""
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and group[i] != group[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (k, _) in zip(group, rows, strict=True):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    return [(k, len(s), least.get(g)) for g, s, (k, _) in zip(group, sets, rows, strict=True)]


def texts():
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(3000)}"
    rows = []
    for n in (5, 6, 9, 30, 80, 300):
        base = [word() for _ in range(n)]
        rows.append(" ".join(base))
        for _ in range(14):
            other = list(base)
            for _ in range(int(rng.integers(0, max(2, n // 25)))):
                other[rng.integers(n)] = word()
            rows.append("  ".join(other) + " tail" * int(rng.integers(0, 2)))
    passage = " ".join(word() for _ in range(60))
    rows += [f"{' '.join(word() for _ in range(40))} {passage} {word()}" for _ in range(60)]
    return [*rows, *rows[3:8], rows[20].upper()]


@pytest.fixture(scope="module")
def rows():
    made = [((i * 7919) % 1009, t) for i, t in enumerate(texts())]
    return [*made, made[4], made[4], (None, made[5][1]), (None, "only here and nowhere else"), (2000, None), (2001, ""), (2002, " \n"), (2003, LONG), (2004, LONG + " y"), (2005, "A b"), (2006, "a B"), (2007, "a b c")]


@pytest.mark.parametrize("tile", [1024, 8])
def test_components_are_those_of_all_pairs(spark, rows, tile, monkeypatch):
    from pointgrain.llm import simhash

    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(simhash, "TILE", tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS node", "'old' AS kept", "'old' AS `x.y`", "map('a', 1) AS m")
    got = H.near_duplicates(df.repartition(5))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == sorted(plain(rows), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["node"] == r["x.y"] == "old" for r in got.collect())


def test_odd_rows(odd_rows, no_rows):
    assert H.near_duplicates(odd_rows).count() == odd_rows.count()
    assert H.near_duplicates(no_rows).count() == 0


def test_estimates_are_true_on_average():
    rng = np.random.default_rng(9)
    for n, shared in ((40, 20), (400, 370), (5000, 100)):
        found = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
            a, b = H.registers(x[:n]), H.registers(x[n - shared :])
            found.append(H.estimate(np.array([(a == b).sum()]), n, n)[0])
        assert np.mean(found) == pytest.approx(shared / (2 * n - shared), abs=0.03)


def test_chance_meetings_of_registers():
    rng = np.random.default_rng(4)
    equal = sum(int((H.registers(rng.integers(0, 1 << 63, 50).astype(np.uint64)) == H.registers(rng.integers(0, 1 << 63, 50).astype(np.uint64))).sum()) for _ in range(1500))
    # Different sets of 50 elements: 1500 * REGISTERS cells meet with probability 2^-10 / (8 ln 2) each, 25 in all.
    assert 8 <= equal <= 50


def test_band_keys_tell_bands_apart():
    regs = np.zeros((2, H.REGISTERS), np.uint16)
    regs[1, 3] = 65535
    keys = H.band_keys(regs)
    assert len(set(keys[0])) == H.REGISTERS // H.BAND and (keys[0] != keys[1]).sum() == 1
