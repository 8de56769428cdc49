import math
import random
import re
from collections import Counter

import numpy as np

from fleetbook.llm import search
from llm.util import LOWER, documents, empty, odd_texts, prose

TERM = re.compile(search.TERM)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, top=20):
    said = [Counter(terms(t)) for _, t in docs]
    n = [sum(s.values()) for s in said]
    total, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for s in said for t in s)
    out = []
    for item_id, text in items:
        scores = []
        for (doc, _), s, size in zip(docs, said, n):
            m = 100 - 25 + (25 * size * total) // max(1, length)
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * s[t]) // (1000 * s[t] + 12 * m))
                        for t, q in Counter(terms(text)).items() if s[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item_id, k + 1, d, -score) for k, (score, _, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus():
    rng = random.Random(5)
    texts = odd_texts() + [prose(rng, rng.randint(1, 80), 60) for _ in range(120)]
    texts += ["Straße straße ﬁ élan ÉLAN élan 12ab", "_only-gaps_", "w1x", "w1x", "w1x w1x"]
    items = [prose(rng, rng.randint(1, 25), 60) for _ in range(25)]
    items += [items[0], items[0].upper(), items[1] + " " + items[2], "", None, "... !!", "nowhere zzz", "élan ÉLAN 12AB straße", "rep rep rep REP"]
    return texts, items


def test_against_brute_force(spark, monkeypatch):
    texts, items = corpus()
    docs = documents(spark, texts, extra=True).repartition(4)
    asked = spark.createDataFrame([(k // 2, t, "x") for k, t in enumerate(items)], "item_id long, text string, score string")
    want = by_hand(list(enumerate(texts)), [(k // 2, t) for k, t in enumerate(items)])
    assert found(search.search(docs, asked)) == want
    monkeypatch.setattr(search, "BLOCK_TERMS", 150)      # several blocks, short segments, few accumulators
    monkeypatch.setattr(search, "SEGMENT", 100)
    monkeypatch.setattr(search, "HELD_BYTES", 4000)
    assert found(search.search(docs, asked)) == want


def test_ids_and_empty(spark):
    rows = [(3, "a b"), (3, "a b"), (None, "a b"), (1, "a b"), (9, "c")] + [(k, "d e f g") for k in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(None, "A"), (4, "b c c")], "item_id long, text string")
    for top in (1, 3, 20):
        assert found(search.search(docs, asked, top)) == by_hand(rows, [(None, "A"), (4, "b c c")], top)
    assert search.search(empty(spark), asked).count() == 0
    assert search.search(docs, empty(spark, "item_id long, text string")).count() == 0


def test_plan_shares():
    rng = random.Random(2)
    base = [f"t{k}" for k in range(30)]
    items = [rng.sample(base, 15) + [f"own{i}x{k}" for k in range(5)] for i in range(60)]
    item, term = zip(*[(i, t) for i, ts in enumerate(items) for t in ts])
    q = [1 + (len(t) % 2) for t in term]
    plan = search.Plan(np.array(item), list(term), np.array(q))
    assert plan.additions() < 0.75 * len(item)
    leaf = np.arange(len(plan.leaf_term))
    value = np.array([hash((plan.terms[t], int(k))) % 1000 for t, k in zip(plan.leaf_term, plan.leaf_q)])
    totals = plan.totals(leaf, np.zeros(len(leaf), int), value, 1)[:, 0]
    assert totals.tolist() == [sum(hash((t.encode(), 1 + len(t) % 2)) % 1000 for t in ts) for ts in items]


def test_long_numbers():
    s = object.__new__(search.Statistics)
    s.documents, s.length = 5 * 10**10, 10**13
    n = np.array([0, 10**9, 7])
    assert s.damping(n).tolist() == [75 + 25 * x * s.documents // s.length for x in n.tolist()]
