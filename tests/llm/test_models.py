import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetbook.llm import classifier, ngram
from fleetbook.llm.common import stored
from fleetbook.llm.queries import QUERIES
from llm.util import LOWER, documents, empty, odd_texts, prose, words


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (5, 3), (100, 50), (1000, 10**9), (300, 2**45)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        ef = ngram.EliasFano(*ngram.EliasFano.encode(values))
        assert ef.get(np.arange(n)).tolist() == values.tolist()
        ask = np.unique(np.concatenate([values, rng.integers(0, top + 10, 200).astype(np.uint64)]))
        found = ef.find(ask)
        for x, at in zip(ask, found):
            assert (at == -1) == (x not in values) and (at == -1 or values[at] == x)


def model_by_hand(docs):
    toks = {i: [*words((t or "").translate(LOWER)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    uni, bi = Counter(), Counter()
    for i, t in toks.items():
        if not held[i]:
            uni.update(t)
            bi.update(zip([0, *t], t))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    size = lambda c: uni[None] if c == 0 else uni[c]
    bucket = lambda c: min(int(math.log2(max(c, 1))), ngram.SIZES - 1)
    fit = np.zeros((ngram.SIZES, len(ngram.GRID)))
    for (c, w), k in bi.items():
        rest = (k - 1) / (size(c) - 1) if size(c) > 1 else 0.0
        fit[bucket(size(c))] += k * np.log10(ngram.GRID * rest + (1 - ngram.GRID) * p1(w))
    weight = ngram.GRID[fit.argmax(axis=1)]
    out = {}
    for i, t in toks.items():
        score = 0.0
        for c, w in zip([0, *t], t):
            s = size(c)
            k = weight[bucket(s)] if s else 0.0
            score += math.log10(k * (bi[c, w] / s if s else 0.0) + (1 - k) * p1(w))
        out[i] = (held[i], len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), score)
    return out


def test_scores_against_brute_force(spark):
    rng = random.Random(5)
    texts = odd_texts() + [" ".join(f"t{(k * k + i) % 37}" for k in range(rng.randint(1, 80))) for i in range(60)]
    want = model_by_hand(list(enumerate(texts)))
    got = ngram.score_documents(documents(spark, texts, extra=True).repartition(5)).collect()
    assert len(got) == len(texts)
    for r in got:
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, abs=2e-3 * n)


def test_no_training_text(spark):
    assert ngram.score_documents(empty(spark)).count() == 0
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    got = ngram.score_documents(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (3, 0, 0)
    assert got["score"] == pytest.approx(got["base_score"])


def test_model_beats_unigrams_on_held_out_text(spark):
    rows = [r for r in QUERIES["op6_lm_scoring"](spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_isotonic():
    assert classifier.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0.25, 1])).tolist() == [0, 0.5, 0.5, 1]
    assert classifier.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def test_normal_equations_are_whole(spark):
    rng = random.Random(4)
    docs = documents(spark, [prose(rng, 5 + i) for i in range(40)]).repartition(7)
    feats = stored(classifier.with_features(docs), "t")
    train = feats.selectExpr("*", "cast(doc_id % 2 as int) as label")
    mean, std = np.zeros(classifier.DIM), np.ones(classifier.DIM)
    gram, moment = classifier.normal_equations(train, mean, std)
    pdf = train.toPandas()
    z = classifier.fourier(pdf[classifier.NAMES].to_numpy(), mean, std)
    assert np.allclose(gram, z.T @ z) and np.allclose(moment, z.T @ (2.0 * pdf["label"] - 1))


def test_classifier_without_labels_and_odd_texts(spark):
    feats = classifier.with_features(documents(spark, odd_texts(), extra=True))
    none = feats.selectExpr("*", "1 as label").filter("false")
    got = classifier.fit_and_score(feats, none).collect()
    assert len(got) == len(odd_texts()) and {r["score"] for r in got} == {0.5}
    one = classifier.fit_and_score(feats, feats.selectExpr("*", "1 as label")).collect()
    assert {r["score"] for r in one} == {1.0}
    assert classifier.with_features(empty(spark)).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (4, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in classifier.training_labels(labels, "quality").collect()) == [(1, 0), (4, 1)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
