import hashlib
import random

import numpy as np

from fleetbook.llm import blocks, repeats, suffixes
from llm.util import documents, empty, odd_texts, prose


def by_hand(docs):
    low = {}
    for i, t in docs:
        b = (t or "").encode()
        key = float("inf") if i is None else i
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            low[w] = min(low.get(w, key), key)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        key = float("inf") if i is None else i
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 49):
            if low[b[k:k + 50]] < key:
                gone[k:k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["rp_bytes"], r["rp_removed"], r["rp_spans"], r["rp_sha256"]) for r in df.collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    shared = [prose(rng, 14, 10**6) for _ in range(6)]
    texts = odd_texts()
    for k in range(60):      # passages of many documents, at any place, next to each other and cut short
        parts = [prose(rng, rng.randint(3, 30), 10**6)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            parts.append(s[rng.randint(0, 30):] + rng.choice(["", " ", "é"]) + prose(rng, rng.randint(0, 9), 10**6))
        texts.append("".join(parts))
    texts += ["ab" * 400, "b" + "ab" * 300, texts[40], texts[40], "-".join(shared)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = documents(spark, texts, extra=True).repartition(5)
    want = by_hand(docs)
    for size in (1000, 3 << 20):
        monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
        assert found(repeats.remove_repeats(df, ["doc_id", "slot", "block"])) == want


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    a = prose(rng, 800, 10**6)
    texts = [a, a[1000:3000] + "!" + a[50:900], prose(rng, 300, 10**6) + a[2000:2600]]
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert found(repeats.remove_repeats(documents(spark, texts), ["doc_id"])) == by_hand(list(enumerate(texts)))


def test_ids(spark):
    text = prose(random.Random(2), 30, 10**6)
    rows = [(5, text), (5, text), (None, text), (7, text + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeats.remove_repeats(df, ["doc_id"])) == by_hand(rows)
    out = repeats.remove_repeats(df, ["doc_id", "text"], texts=True).filter("doc_id = 7").first()
    assert out["rp_text"] == "x"
    assert repeats.remove_repeats(empty(spark), ["doc_id"]).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 300, 2000):
        for letters in (1, 2, 5):
            data = rng.integers(97, 97 + letters, n).astype(np.uint8)
            if n > 200:
                data[120:190] = data[10:80]
            b = data.tobytes()
            order = suffixes.suffix_array(data)
            assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
            want = [0]
            for i, j in zip(order[:-1], order[1:]):
                k = 0
                while k < 50 and max(i, j) + k < n and b[i + k] == b[j + k]:
                    k += 1
                want.append(k)
            assert suffixes.kasai(data, order).tolist() == want
