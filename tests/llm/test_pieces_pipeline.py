import random

import pytest

import corpus_pipeline
from fleetbook.llm import pieces
from fleetbook.llm.common import stored
from llm.util import DOC, documents, empty, odd_texts, prose, rows

MODEL = open(pieces.MODEL, "rb").read()
VOCABULARY = pieces.Vocabulary(MODEL)


def odd_text(rng, k):
    parts = ["the", "then", "there", "and", "island", "tion", "éà", "日本", "ÿ", "4567", ",.", "<s>", "\n", "\t", "x"]
    gaps = ["", "", " ", "  ", " " * rng.choice([1, 7, 20])] if k % 3 == 0 else ["", " "]
    text = "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(1, 60)))
    return text.replace(" ", "") if k % 4 == 0 else text


def test_scan_equals_the_library(spark):
    rng = random.Random(6)
    texts = [odd_text(rng, k) for k in range(120)] + odd_texts() + [" ", "  ", "a ", "the" * 200, " " * 100 + "a" + " " * 90]
    for chunk, reach in ((7, 0), (16, 5), (64, 20), (32768, 1024)):
        out = pieces.encode_documents(documents(spark, texts, extra=True), chunk=chunk, reach=reach).orderBy("doc_id", "chunk_no").collect()
        got = {i: [] for i in range(len(texts))}
        for r in out:
            got[r["doc_id"]] += r["ids"]
            assert r["n_pieces"] == len(r["ids"])
        assert list(got.values()) == [VOCABULARY.lib.encode(t or "") for t in texts]
        if chunk == 32768:
            assert all(r["round_trip"] for r in out if "▁" not in (texts[r["doc_id"]] or ""))


def test_max_plus_is_associative():
    rng = random.Random(2)
    make = lambda: {((i, 0), (j, 0)): rng.randint(-9, 0) for i in range(3) for j in range(3) if rng.random() < 0.7}
    for _ in range(50):
        a, b, c = make(), make(), make()
        assert pieces.max_plus(pieces.max_plus(a, b), c) == pieces.max_plus(a, pieces.max_plus(b, c))
        line = [make() for _ in range(7)]
        upto = line[0]
        for i, m in enumerate(line[1:], 1):
            upto = pieces.max_plus(upto, m)
            assert pieces.scan(line)[i] == upto


def test_no_documents_and_no_model(spark):
    assert pieces.encode_documents(empty(spark)).count() == 0
    with pytest.raises(FileNotFoundError):
        pieces.encode_documents(empty(spark), model_path="/nowhere/model")


def test_stages(spark):
    """Stage contracts: columns, whole rows, and decisions that take effect."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' as mean", "'y' as slot")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), "t")
        assert out.columns == docs.columns, name
        before = {r[0] for r in docs.select("doc_id").collect()}
        assert {r[0] for r in out.select("doc_id").collect()} <= before
        if "mixing" in name:
            assert out.count() >= docs.count()
        elif "suffix" in name:
            assert out.count() == docs.count()
            assert rows(out.selectExpr("sum(n_chars) = sum(char_length(text))")) == [(True,)]
        else:
            assert out.count() < docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.select("rec_id").distinct().count() == docs.count()


def test_stages_on_no_and_odd_documents(spark):
    for docs in (empty(spark), documents(spark, odd_texts()).selectExpr("case when doc_id > 1 then doc_id end as doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").collect()


def test_one_of_each_group_stays(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(3, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, "en", "s", 1)],
                                 documents(spark, []).schema)
    assert rows(corpus_pipeline.near_duplicates(spark, docs, ""), "doc_id") == [(1,), (None,)]


def test_rows_that_share_an_id(spark):
    """No row is lost for sharing an id; rows that repeat id and text are one document, the same on every run."""
    rng = random.Random(5)
    a, b = prose(rng, 60, 10**6), prose(rng, 70, 10**6)
    rows_in = [(1, a, "en", "s1", 5), (1, b, "en", "s1", 5), (1, a, "de", "s0", 5), (0, b + " x", "en", "s1", 5), (2, "short", None, None, None)]
    docs = spark.createDataFrame(rows_in, DOC).repartition(4)
    assert rows(corpus_pipeline.near_duplicates(spark, docs, "")) == sorted(
        [(1, a, "de", "s0", 5), (0, b + " x", "en", "s1", 5), (2, "short", None, None, None)], key=repr)
