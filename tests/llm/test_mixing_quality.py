import numpy as np
import pytest

from fleetbook.llm import mixing, quality
from fleetbook.llm.common import stored
from llm.util import DOC, documents, empty, odd_texts, rows, words


def water_fill(sizes):
    """Shares by weight; what exceeds a cap is shared again until nothing does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in names if s not in open_)
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 2.0 * sizes[s] + 1e-9}
        if not over:
            return {s: left * weight[s] / whole if s in open_ else 2.0 * sizes[s] for s in names}
        open_ -= over


def mixed(docs):
    slim = mixing.sized(docs)
    return mixing.apply_plan(slim, mixing.mixing_plan(slim)).collect()


def test_targets_and_taken(spark):
    texts = [" ".join(["w"] * (1 + (i * 37) % 90)) for i in range(600)] + odd_texts()
    got = mixed(documents(spark, texts, extra=True))
    assert len(got) == len(texts)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["mix_size"] == len(words(texts[r["doc_id"]])) and r["mix_repeats"] in (0, 1, 2)
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_size"] * r["mix_repeats"]
        target[r["source"]] = r["mix_target"]
    want = water_fill(sizes)
    largest = max(len(words(t)) for t in texts)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest
    again = {(r["doc_id"], r["mix_repeats"]) for r in mixed(documents(spark, texts).repartition(7))}
    assert again == {(r["doc_id"], r["mix_repeats"]) for r in got}


def test_mix_rows_and_empty(spark):
    docs = documents(spark, odd_texts(), extra=True)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert set(n.values()) <= {1, 2}
    assert mixing.mix_documents(empty(spark)).count() == 0
    assert mixed(documents(spark, [None, "", " "])) != []


def stats_by_hand(text):
    text = text or ""
    w = words(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    dup, lines = 0, set()
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(cover))


def test_statistics(spark):
    texts = odd_texts() + ["a b c\na b c\n \na b c", "#$ <b> x|y", "a b c d a b c e a b c"]
    docs = documents(spark, texts, extra=True)
    got = quality.with_stats(docs, ["doc_id", "n", "qs_text"]).collect()
    assert [tuple(r[f"qs_{s}"] for s in quality.STATS) for r in sorted(got, key=lambda r: r["doc_id"])] == [stats_by_hand(t) for t in texts]


def mcd_by_search(x, tries=300):
    """Log determinant, mean and inverse by concentration from many random subsets, on exact distances."""
    rng = np.random.default_rng(1)
    h = int(np.ceil(quality.COVERAGE * len(x)))
    best = None
    for _ in range(tries):
        at, last = rng.choice(len(x), quality.DIM + 1, replace=False), np.inf
        while True:
            mean = x[at].mean(axis=0)
            cov = np.cov(x[at].T, bias=True) * quality.consistency(quality.COVERAGE) + np.diag(np.square(quality.FLOOR))
            logdet, inv = np.linalg.slogdet(cov)[1], np.linalg.inv(cov)
            if len(at) == h and logdet > last - 1e-9:
                break
            last = logdet if len(at) == h else np.inf
            d = np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)
            at = np.argsort(d, kind="stable")[:h]
        if best is None or logdet < best[0]:
            best = logdet, mean, inv
    return best


def distances(x, mean, inv):
    inv = np.reshape(inv, (quality.DIM, quality.DIM))
    return np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)


def vectors(stats):
    return np.array([[np.log(a), np.log(max(b, 1) / a), np.sqrt(c / a), np.sqrt(d / a), np.sqrt(e / a)] for a, b, c, d, e in stats])


def test_mcd_against_numpy_and_outliers(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(300):
        n = int(rng.integers(60, 400))
        out.append(" ".join("abcdefghij"[: int(rng.integers(2, 9))] + str(rng.integers(0, 10**6)) for _ in range(n)))
    junk = [" ".join(f"a{k}###%%%" for k in range(100, 250)) for _ in range(30)]
    rows_ = [(i, t, "en", "s" if i % 2 else None, 0) for i, t in enumerate(out + junk)] + [(900, None, None, None, 0), (901, out[0], "xx", "rare", 0)]
    stats = stored(quality.with_stats(spark.createDataFrame(rows_, DOC), ["doc_id", "lang", "source"]), "t")
    fit = quality.fit_mcd(stats)
    for r in fit.filter("level = 0 and lang = 'en'").collect():
        v = vectors([stats_by_hand(t) for i, t, _, s, _ in rows_ if s == r["source"] and _lang(i) and not _fails(t)])
        logdet, mean, inv = mcd_by_search(v)
        assert r["logdet"] < logdet + 0.2         # buckets hold a little more than the share
        mine, best = distances(v, r["mean"], r["inv"]), distances(v, mean, inv)
        assert np.mean((mine > quality.CUTOFF) == (best > quality.CUTOFF)) > 0.98
    kept = {r["doc_id"]: r["qs_kept"] for r in quality.judge(stats, fit).collect()}
    assert sum(kept[i] for i in range(300)) >= 297 and not any(kept[300 + i] for i in range(30))
    assert not kept[900] and kept[901]          # no text; alone in its language, judged by the fit of all
    none = quality.with_stats(empty(spark), ["doc_id", "lang", "source"])
    assert quality.judge(none, quality.fit_mcd(none)).count() == 0


def _lang(i):
    return i < 900


def _fails(text):
    n, _, _, _, rep = stats_by_hand(text)
    return n < 50 or 100 * rep > 50 * n


def test_moderate_outliers_of_each_statistic(spark):
    """One statistic off, the others ordinary, next to clean documents of the same group."""
    rng = np.random.default_rng(9)
    word = lambda k=6: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(k - 3, k + 4))))
    clean = [" ".join(word() for _ in range(int(rng.lognormal(5.3, 0.4)) + 60)) for _ in range(300)]
    base = [word() for _ in range(200)]
    wide = [base[:10] * 9 + base[10:120], [w + "$" if i % 12 == 0 else w for i, w in enumerate(base)], [word(18) for _ in range(200)], [word() for _ in range(6000)]]
    lines = "\n".join([" ".join(base[k:k + 10]) for k in range(0, 200, 10)] + ["x"] * 12)
    texts = clean + [" ".join(w) for w in wide] + [lines]
    assert not any(_fails(t) for t in texts)
    stats = stored(quality.with_stats(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC), ["doc_id", "lang", "source"]), "t")
    kept = {r["doc_id"]: r["qs_kept"] for r in quality.judge(stats, quality.fit_mcd(stats)).collect()}
    assert quality.CUTOFF == pytest.approx(20.515, abs=0.01)
    assert [i for i in range(300, len(texts)) if kept[i]] == [] and sum(kept[i] for i in range(300)) >= 294


@pytest.mark.parametrize("share,off", [(0.15, 6), (0.24, 6), (0.24, 10)])
def test_clustered_junk(spark, share, off):
    """Up to a quarter of a group as one tight cluster, off in two statistics."""
    rng = np.random.default_rng(11)
    n, junk = 2000, int(2000 * share)
    words_n = np.round(np.exp(rng.normal(6, 0.5, n))).clip(60)
    rate = rng.normal(0.5, 0.04, (n, 3))
    rate[:junk, :2] = 0.5 + 0.04 * off + rng.normal(0, 0.005, (junk, 2))
    counts = np.round(np.square(rate) * words_n[:, None])
    counts[:, 2] = np.minimum(counts[:, 2], np.floor(words_n / 2))
    chars = np.round(words_n * np.exp(rng.normal(1.6, 0.1, n)))
    data = [(i, "en", "s", int(w), int(c), *map(int, k)) for i, (w, c, k) in enumerate(zip(words_n, chars, counts))]
    stats = stored(spark.createDataFrame(data, "doc_id long, lang string, source string, " + ", ".join(f"qs_{s} long" for s in quality.STATS)), "t")
    kept = {r["doc_id"]: r["qs_kept"] for r in quality.judge(stats, quality.fit_mcd(stats)).collect()}
    assert not any(kept[i] for i in range(junk))
    assert sum(kept[i] for i in range(junk, n)) >= 0.97 * (n - junk)


def test_every_small_group_is_judged(spark):
    """Languages and sources of a few documents: an outlier among them goes by the fit of all."""
    rng = np.random.default_rng(2)
    text = lambda extra="": " ".join("abcdefghij"[: int(rng.integers(3, 9))] + str(rng.integers(0, 10**6)) + extra for _ in range(int(rng.integers(80, 300))))
    rows_ = [(i, text(), f"l{i % 20}", f"s{i}", 0) for i in range(200)] + [(500 + i, text("#$%<>"), f"l{i}", None, 0) for i in range(10)]
    stats = stored(quality.with_stats(spark.createDataFrame(rows_, DOC), ["doc_id", "lang", "source"]), "t")
    got = quality.judge(stats, quality.fit_mcd(stats)).collect()
    assert all(r["qs_distance"] is not None for r in got)
    kept = {r["doc_id"]: r["qs_kept"] for r in got}
    assert not any(kept[500 + i] for i in range(10)) and sum(kept[i] for i in range(200)) >= 196
