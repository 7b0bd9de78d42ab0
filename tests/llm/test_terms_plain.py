"""Disclosing terms against a plain version that goes through all texts, entities and words."""

import math
import random
import re

import pytest

from pointgrain.llm import pii
from tests.llm.test_numbered import plain_spans

WORDS = re.compile(r"[^\W_]+")


def words(text):
    return {w for w in WORDS.findall(text.lower()) if len(w) >= 3}


def plain_terms(texts):
    texts = sorted(set(texts))
    named, said, stand = {}, [], {}
    for i, t in enumerate(texts):
        cut, outside, last = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(t)], [], 0
        for a, b in cut:
            outside.append(t[last:a])
            last = max(last, b)
            context = tuple(tuple(w for w in WORDS.findall(x.lower()) if len(w) >= 3) for x in (t[max(0, a - pii.REACH) : a], t[b : b + pii.REACH]))
            named.setdefault(t[a:b].lower(), {}).setdefault(i, context)
        said.append(words(" ".join([*outside, t[last:]])) if cut else set())
        for w in set(WORDS.findall(t.lower())):
            stand.setdefault(w, set()).add(i)
    found = set()
    for where in named.values():
        held = math.log(len(texts) / len(where))
        for w in set().union(*(said[i] for i in where)):
            both = [i for i in where if w in said[i]]
            told = math.log(len(texts) * len(both) / (len(where) * len(stand[w])))
            if held > 0 and len({where[i] for i in both}) >= pii.SUPPORT and told >= pii.DISCLOSURE * held - 1e-12:
                found.add(w)
    return found


def marked(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in pii.find(df).collect() for s in r["terms"]}


def plain_text(rnd, more=()):
    body = [rnd.choice("lorem ipsum dolor sit amet tempor magna aliqua quis nisi".split()) + rnd.choice(["", "", f"{rnd.randrange(60)}x"]) for _ in range(14)]
    for x in more:
        body.insert(rnd.randrange(len(body)), x)
    return " ".join(body)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_equal_the_plain_ones(spark, seed):
    rnd, texts = random.Random(seed), []
    for name in ("ann@x.org", "bob@y.org", "10.2.3.4"):
        nick, other = f"nick{rnd.randrange(9)}{name[:3].replace('.', '')}", f"pal{name[:2].replace('.', '')}q"
        for k in range(rnd.randrange(3, 9)):
            texts.append(plain_text(rnd, [name, f"unique{seed}{name[:2].replace('.', '')}{k}", nick, *([other] if k % 2 else [])]))
    texts += [plain_text(rnd, ["carl@z.org"]) + " alone here"] + [plain_text(rnd) for _ in range(120)]
    texts += [plain_text(rnd, [w]) for t in texts[:4] for w in t.split() if w.startswith("pal")]
    want = plain_terms(texts)
    assert want and marked(spark, [*texts, *texts[:5], *texts[:1] * 4]) == want


def test_one_text_with_many_mentions_discloses_nothing(spark):
    rare = "thunderstorm saxophone marmalade"
    one = f"the bob@x.org said {rare} today, write bob@x.org soon, and again bob@x.org then"
    texts = [one, one, *(f"plain words number {i} of a common kind" for i in range(200))]
    assert marked(spark, texts) == set() == plain_terms(texts)
    # Near copies that name it alike are one context, whatever changes far away from the entity.
    far = "so it went on and on " * 6
    texts = [f"{rare} {far} call bob@x.org now {far} ending{i}" for i in range(5)] + texts[2:]
    assert marked(spark, texts) == set() == plain_terms(texts)


def test_many_mentions_in_some_texts(spark):
    texts = [" ".join(f"w{(i * k) % 17}xx bob@x.org e{i}@y{k}.org" for i in range(400)) + f" kestrel last{k}" for k in range(4)] + [f"plain words number {i}" for i in range(60)]
    got = marked(spark, texts)
    assert "kestrel" in got and not {f"last{k}" for k in range(4)} & got
