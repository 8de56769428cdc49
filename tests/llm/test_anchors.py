import random
from collections import Counter

from fleetbook.llm import anchors, blocks
from llm.util import documents, empty, odd_texts, prose, words


def by_hand(texts):
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i:i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for k, w in enumerate(split):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        spans = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((k, len(w), sum(gone), len(spans), kept))
    return out


def found(df):
    return sorted((r["doc"]["doc_id"], r["words"], r["removed"], len(r["spans"]), r["text"]) for r in df.collect())


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 90, 10**6) for _ in range(5)]
    texts = odd_texts()
    for _ in range(60):      # passages cut short at both ends, at any place, next to each other
        parts = [prose(rng, rng.randint(0, 60), 10**6)]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(shared).split()
            a, b = rng.randint(0, 40), rng.randint(60, 90)
            parts += [" ".join(w[a:b]), prose(rng, rng.randint(0, 9), 10**6)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    w = shared[0].split()
    texts += [" ".join(w[:35]) + " end", " ".join(w[1:35]) + " end", "a b " * 60, "c " * 35, "d " * 36, texts[40], texts[40], "\n".join(shared)]
    return texts


def test_against_brute_force(spark, monkeypatch):
    texts = passages(4)
    want = by_hand(texts)
    df = documents(spark, texts, extra=True)
    for block, piece, parts in ((1000, 900, 5), (3 << 20, 1 << 20, 1), (20000, 333, 3)):
        monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
        monkeypatch.setattr(anchors, "PIECE", piece)
        assert found(anchors.remove_passages(df.repartition(parts), ["doc_id", "slot", "text", "n"])) == want


def test_spans_rows_and_ids(spark):
    w = prose(random.Random(1), 40, 10**6)
    df = spark.createDataFrame([(5, w), (5, w), (None, "x " + w + " y"), (7, None)], "doc_id long, text string")
    rows = anchors.remove_passages(df, ["doc_id"]).collect()
    got = sorted(((r["doc"]["doc_id"], r["words"], r["removed"], [tuple(s) for s in r["spans"]], r["text"]) for r in rows), key=repr)
    assert got == sorted([(5, 40, 40, [(0, 40)], ""), (5, 40, 40, [(0, 40)], ""), (None, 42, 40, [(1, 41)], "x y"), (7, 0, 0, [], "")], key=repr)
    assert anchors.remove_passages(empty(spark), ["doc_id"]).count() == 0


def test_pieces_overlap():
    data = prose(random.Random(2), 3000).encode()
    cores = [p[:n] for p, n in anchors.cut_text(data)]
    assert b"".join(cores) == data
    for p, n in list(anchors.cut_text(data))[:-1]:
        assert len(p[n:].split()) == 34
