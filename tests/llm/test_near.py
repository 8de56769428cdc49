import random

import numpy as np

import corpus_pipeline
from fleetbook.llm import embeddings, graph, minhash
from llm.util import documents, empty, odd_texts, prose, rows, shingles, words


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def components_by_hand(texts):
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    return sets, union(pairs, range(len(sets)))


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (21, 20), (50, 41), (50, 42), (50, 43)]
    got = rows(graph.components(spark.createDataFrame(links, "a long, b long")))
    want = union([x for x in links if x[0] != x[1]], {n for x in links if x[0] != x[1] for n in x})
    assert got == sorted(want.items(), key=repr)
    assert graph.components(empty(spark, "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    texts = odd_texts()
    for size in (40, 90):                      # a group around one text, edited more and more
        base = prose(rng, size, 10**6).split()
        for k in range(60):
            w = list(base)
            for _ in range(k // 8):
                w[rng.randrange(size)] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [prose(rng, 50, 10**6) for _ in range(30)]
    sets, want = components_by_hand(texts)
    got = minhash.near_duplicates(documents(spark, texts, extra=True).repartition(6)).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_rest_pairs_find_links_that_hubs_miss(spark):
    """Two documents linked with each other but not with the smallest of their bucket."""
    a = [f"a{i}" for i in range(100)]
    far = a[:90] + [f"f{i}" for i in range(10)]
    near = a[:89] + ["g"] + far[90:]
    texts = [" ".join(a), " ".join(far), " ".join(near)]
    _, want = components_by_hand(texts)
    assert want == {0: 0, 1: 1, 2: 1}
    sets = minhash.document_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumnRenamed("doc_id", "rep")
    from fleetbook.llm.common import stored
    label = stored(spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "rep long, comp long"), "t")
    sets = stored(sets, "t")
    assert rows(minhash.confirm(minhash.rest_pairs(sets, label), sets)) == [(2, 1)]


def test_near_edge_cases(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    got = rows(minhash.near_duplicates(spark.createDataFrame(
        [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (6, None), (7, "A B C D")], "doc_id long, text string")).drop("digest"))
    assert got == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4), (6, 0, 6), (7, 2, 4)], key=repr)


def test_texts_that_share_an_id(spark):
    """Each row of a repeated id is linked by its own text."""
    rng = random.Random(17)
    a, b = prose(rng, 58, 10**6), prose(rng, 90, 10**6)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "far away from all"), (1, a)],
                                 "doc_id long, text string").repartition(3)
    got = rows(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == [(1, 56, 1), (1, 56, 1), (1, 88, 1), (2, 57, 1), (3, 89, 1), (4, 2, 4)]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    for k in range(120):                        # a dense group, wider than a window, and loose ones
        x[200 + k] = x[0] + 0.1 * rng.normal(size=24)
    for k in range(20):
        x[350 + k] = x[10 + k // 2] + 0.25 * rng.normal(size=24)
    x[399] = x[398]
    x[397] = 3 * x[398]
    vectors = [v.astype(np.float32).tolist() for v in x]
    data = [(i, v, "l") for i, v in enumerate(vectors)]
    data += [(500, None, "l"), (501, [], "l"), (502, [0.0] * 24, "l"), (503, [float("nan")] * 24, "l"), (504, [None] * 24, "l"),
             (505, vectors[0][:23], "l"), (506, [1e30] * 24, "l"), (507, [2e30] * 24, "l")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, unit string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    ok = {i: np.array(v, dtype=float) for i, v, _ in data if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in ok.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(i, j) for i in ok for j in ok if j < i and len(ok[i]) == len(ok[j]) and unit[i] @ unit[j] >= 0.9]
    comp = union(links, [d[0] for d in data])
    count = {d[0]: sum(d[0] in p for p in links) for d in data}
    assert got == {i: (count[i], comp[i]) for i in count}


def test_no_vectors(spark):
    assert embeddings.near_vectors(empty(spark, "vec_id long, embedding array<float>")).count() == 0
    got = embeddings.near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>"))
    assert rows(got) == [(1, 0, 1), (2, 0, 2)]


def near_group(n, group, dim, seed):
    """Vectors of which the first ``group`` are close to each other, and links per vector."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[:group] = x[0] + 0.02 * rng.normal(size=(group, dim))
    x = x.astype(np.float32)
    z = embeddings.unit_vectors(x)
    links = (z @ z.T >= 0.9).sum(axis=1) - 1
    return x, links


def test_group_over_many_partitions_and_blocks(spark):
    """A dense group, with partitions and blocks far smaller than the group."""
    x, links = near_group(400, 250, 16, 8)
    assert links[:250].min() == 249
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        found = embeddings.stored(embeddings.near_vectors(df, block=64), "t")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert [got[i] for i in range(250)] == [(int(links[i]), 0) for i in range(250)]
    assert sum(n for n, _ in got.values()) <= links.sum()


def test_passes_grow_with_the_table():
    for rows_ in (0, 1, 500, 10**5, 10**6, 10**7, 10**8, 10**9):
        passes = embeddings.passes_for(rows_)
        bits = max(np.log2(max(rows_, 1) / embeddings.WINDOW), 0)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes > 0.99
        assert bits < embeddings.BITS
    assert embeddings.passes_for(10**8) > embeddings.passes_for(10**6) > embeddings.passes_for(500)


def test_stage_against_brute_force(spark):
    """The pipeline's rule: five words, similarity 0.8 or more."""
    rng = random.Random(5)
    texts = [None, "", "one two", "one two", "ONE two three four", "a b c d e"]
    for k in range(40):                       # copies with 5 to 35 of 150 words added at the end
        w = prose(rng, 150, 10**6)
        texts += [w, w + " " + prose(rng, 5 + 30 * k // 39, 10**6)]
    for k in range(20):                       # edits of single words
        w = prose(rng, 150, 10**6).split()
        texts.append(" ".join(w))
        for i in range(0, 150, 40 - k):
            w[i] = f"edit{i}"
        texts.append(" ".join(w))
    grams = []
    for t in texts:
        w = words((t or "").lower())
        grams.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if grams[i] and grams[j]
             and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    want = union(pairs, range(len(texts)))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(spark, texts), "").collect()}
    assert kept == {i for i in want if want[i] == i} and 40 < len(pairs) < 61
