import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fleetbook.llm import align, queries
from fleetbook.llm.common import bound_batches
from llm.util import documents, empty, odd_texts, prose


@pytest.fixture(scope="module")
def vocabularies():
    return align.Vocabularies(*(open(p, "rb").read() for p in (align.VOCABULARY_A, align.MODEL_B)))


def tokens_by_hand(v, text):
    if not text:
        return [], []
    said = (" " + text).encode()
    a = v.library.encode(" " + text, add_special_tokens=False).ids
    b = v.model.encode(text)
    ok = b"".join(v.bytes_a[i] for i in a) == said == b"".join(v.bytes_b[i] for i in b)
    return (a, b) if ok else ([], [])


def by_hand(v, texts):
    """Links by comparing the byte ranges of tokens group by group."""
    rows, held = [], defaultdict(set)
    for k, text in enumerate(texts):
        a, b = tokens_by_hand(v, text)
        groups, i, j, ea, eb, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if ea <= eb:
                ga.append(a[i])
                ea += len(v.bytes_a[a[i]])
                i += 1
            else:
                gb.append(b[j])
                eb += len(v.bytes_b[b[j]])
                j += 1
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        for pair in links:
            held[pair].add(k)
        rows.append((k, a, b, groups, links))
    top = Counter()
    for (x, _), docs in held.items():
        top[x] = max(top[x], len(docs))
    out = []
    for k, a, b, groups, links in rows:
        s = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((k, len(a), len(b), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if len(held[p]) == top[p[0]]), sum(n * len(held[p]) for p, n in links.items()),
                    hashlib.sha256(s.encode()).hexdigest() if a else ""))
    return out


def texts():
    rng = random.Random(6)
    chars = "aábΩ中🙂 \n\t.,'19<|>_ñ́ \u0085　ſ"
    noise = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [*odd_texts(), *noise, "", " ", "  two", "trailing  ", "<|endoftext|> <s></s> <0x41>", "x" * 3000, "zq" * 900,
            " " * 1200 + "a", "don't they'll", "ok ١٢ مرحبا", "same text here", "same text here"]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_against_brute_force(spark, vocabularies, monkeypatch):
    bound_batches(spark)
    given = texts()
    want = by_hand(vocabularies, given)
    df = documents(spark, given, extra=True).drop("rep", "n")
    got = queries.aligned_documents(df.repartition(4))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want
    # small units, chunks, pair chunks and postings: a document's links come in several parts
    for name, value in (("UNIT_BYTES", 300), ("CHUNK", 200), ("PAIRS", 40), ("HELD", 100)):
        monkeypatch.setattr(align, name, value)
    parts = list(align.Vocabularies.chunks(vocabularies, given[20]))
    assert len(parts) > 20 and "".join(parts) == given[20]
    assert [sum(x, []) for x in zip(*[(p[0].tolist(), p[1].tolist()) for p in vocabularies.encode(given[20])])] == list(tokens_by_hand(vocabularies, given[20]))


def test_small_parts(vocabularies, monkeypatch):
    """Groups and postings do not depend on how they are cut."""
    given = [t for t in texts() if tokens_by_hand(vocabularies, t)[0]]

    def links():
        out = Counter()
        for k, t in enumerate(given):
            g = align.Groups(vocabularies, vocabularies.encode(t))
            for key, _, m in g.pairs():
                for x, n in zip(key.tolist(), m.tolist()):
                    out[k, x >> 32, x & 0xFFFFFFFF] += n
        return out

    want = Counter({(k, *p): n for k, t in enumerate(given) for p, n in by_hand_links(vocabularies, t).items()})
    assert links() == want
    monkeypatch.setattr(align, "PAIRS", 7)
    monkeypatch.setattr(align, "CHUNK", 100)
    assert links() == want


def by_hand_links(v, text):
    a, b = tokens_by_hand(v, text)
    ends = [np.cumsum([len(x[i]) for i in ids]) for x, ids in ((v.bytes_a, a), (v.bytes_b, b))]
    cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    groups = [np.searchsorted(cuts, e) for e in ends]
    right = defaultdict(list)
    for y, h in zip(b, groups[1]):
        right[h].append(y)
    return Counter((x, y) for x, g in zip(a, groups[0]) for y in right[g])


def test_planes():
    rng = np.random.default_rng(3)
    key, pos, m = align.summed(np.repeat(np.arange(40), 1500), rng.integers(0, align.CONTAINER, 60000), rng.integers(1, 5, 60000))
    keep = (key % 3 == 0) | (rng.random(len(key)) < 0.02)
    keep[np.searchsorted(key, np.arange(40))] = True
    key, pos, m = key[keep], pos[keep], m[keep]
    planes = align.encode_planes(key, pos, m, 40)
    assert {len(x) for x in planes.flatten().to_pylist()} > {align.CONTAINER // 8}
    for part, shift in ((planes, 0), (planes.slice(7), 7), (pa.concat_arrays([planes, planes]).slice(40), 0)):
        k, p, n = align.summed(*align.decode_planes(part))
        here = key >= shift
        assert (k + shift).tolist() == key[here].tolist() and p.tolist() == pos[here].tolist() and n.tolist() == m[here].tolist()


def test_merge_of_parts(spark):
    """Postings of one pair and container from several parts, a document in two of them."""
    rows = []
    for part in ([(1, 3, 2), (1, 9, 1)], [(1, 3, 3), (2, 4, 1)], [(1, 8000, 1)]):
        key, pos, m = (np.array(x) for x in zip(*part))
        for k in np.unique(key):
            here = key == k
            planes = align.encode_planes(np.zeros(here.sum(), int), pos[here], m[here], 1)
            rows.append((int(k), 7, 5, planes[0].as_py()))
    df = spark.createDataFrame(rows, "a int, b int, container long, planes array<binary>")
    out = {r["a"]: (r["n_docs"], r["n_links"]) for r in align.merged(df).collect()}
    assert out == {1: (3, 7), 2: (1, 1)}


def test_both_encoders_agree(vocabularies):
    """Below U+0600 the rank encoder and the library split every character alike."""
    for c in map(chr, range(1, 0x600)):
        t = f"a{c}b {c}{c} 1{c}1  {c} '{c}s\n{c}\t{c}x"
        assert vocabularies.ranks.encode_ordinary(t) == vocabularies.library.encode(t, add_special_tokens=False).ids


def test_empty_and_ids(spark):
    assert queries.aligned_documents(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "one two"), (4, "one two"), (4, "one"), (5, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_links"], r["count_sum"]) for r in queries.aligned_documents(df).collect()), key=repr)
    assert got == [(4, 1, 3), (4, 2, 5), (5, 0, 0), (None, 2, 5)]


def test_long_words(spark):
    rng = random.Random(1)
    text = prose(rng, 30000)
    r = queries.aligned_documents(documents(spark, [text])).first()
    assert r["n_links"] == r["count_sum"] == r["n_best"] and r["n_a"] > 30000


def held(v, given):
    words = align.Words(v)
    for text in given:
        words.add(text)
    return align.Held(words)


def test_words_as_in_their_text(vocabularies, monkeypatch):
    """Words that are tokenized by themselves or beside others have the tokens, groups and links of the whole text."""
    rng = random.Random(8)
    marks = "a b1 '.|\u2581\u0301\x1c\x85\xa0\u180e\u2003\u200b\u2019\u0661\u4e2d\u1100\u044f\U0001f642\n\t"
    given = [*texts(), *["".join(rng.choice(marks) + rng.choice(["", " ", "x "]) for _ in range(rng.randint(1, 40))) for _ in range(200)]]
    want = []
    for t in given:
        a, b = tokens_by_hand(vocabularies, t)
        want.append((len(a), len(b), by_hand_links(vocabularies, t) if a else Counter()))
    for piece in (align.PIECE, 30, 1):
        monkeypatch.setattr(align, "PIECE", piece)
        got = held(vocabularies, given)
        numbers, written, links = got.numbers(), got.written(), [Counter() for _ in given]
        for key, doc, m in got.pairs():
            for x, d, n in zip(key.tolist(), doc.tolist(), m.tolist()):
                links[d][x >> 32, x & 0xFFFFFFFF] += n
        for t, w, n, s, found in zip(given, want, numbers.tolist(), written, links):
            assert (n[0], n[1], found) == w and n[3] == sum(found.values()), t
            assert n[2] == (len(s.split(";")) if s else 0)
            sides = [[int(x) for g in s.split(";") for x in g.split("|")[k].split(",")] if s else [] for k in (0, 1)]
            assert sides == [list(x) for x in tokens_by_hand(vocabularies, t)]
    assert sum(w[0] == 0 for w in want) > 5


def test_distinct_words_are_tokenized_once(vocabularies, monkeypatch):
    """Both tokenizers read the distinct words of a unit, not every text (they took most of the CPU time)."""
    rng = random.Random(9)
    given, read = [prose(rng, 300) for _ in range(50)], []
    monkeypatch.setattr(align.Vocabularies, "encode_a", lambda v, s: read.append(s) or v.ranks.encode_ordinary(s))
    assert held(vocabularies, given).numbers()[:, 0].tolist() == [len(tokens_by_hand(vocabularies, t)[0]) for t in given]
    assert sum(map(len, read)) < 5000 < sum(map(len, given)) / 10


def test_words_without_cuts(vocabularies, monkeypatch):
    """A vocabulary whose tokens go past spaces has whole texts for words."""
    given = ["one two three", "two three", None]
    want = held(vocabularies, given)
    monkeypatch.setattr(vocabularies, "cuts", False)
    got = held(vocabularies, given)
    assert (got.numbers() == want.numbers()).all() and got.written() == want.written() and len(got.word) == 2 < len(want.word)
