import hashlib

from fleetbook.llm import warc
from fleetbook.llm.common import shared_path, stored
from llm.util import empty

PAGE = "page_id long, url string, html string, kind string"


def expect(pages):
    first = {}
    for i, _, h, _ in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        f = first.get(b, i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out, key=repr)


def test_round_trip(spark):
    line = "WARC/1.1\r\n"
    big = "é" * 1000 + line + "x" * 777 + "\r\n\r\n" + line + line + "y" * 500
    pages = [(1, "http://a/ b\r\nX: y", big, "k"), (2, None, big, "k"), (3, "u", None, "k"), (4, "u", "", "k"), (5, "u", "short", "k"),
             (6, "u", "short", "k"), (7, "u", line * 30, "k"), (8, "u", "\r\n\r\n" * 50, "k"), (9, "u", "z" * 100, "k"),
             (10, "u", "z" * 100, "k"), (11, "u", "z" * 99, "k"), (12, "u", "z" * 99, "k"), (13, "u", "q" * 5000, "k"),
             (13, "u", "q" * 5000, "k"), (14, "u", "\x00\x1f" * 300, "k"), (0, "u", "z" * 100, "k")]
    for chunk in (64, 1000, 1 << 16):
        got = warc.archive_pages(spark.createDataFrame(pages, PAGE).repartition(3), chunk)
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["kind"], r["refers_to"]) for r in got.collect()), key=repr) == expect(pages)


def test_chunks_carry_running_digests(spark):
    text = "abc" * 100
    got = warc.chunk_records(spark.createDataFrame([(1, "u", text, "k")], PAGE), "page_id", "url", "html", 64).orderBy("chunk_no").collect()
    assert [len(r["data"]) for r in got] == [64, 64, 64, 64, 44] and [r["last"] for r in got] == [False] * 4 + [True]
    assert all(r["digest"] == hashlib.sha256(text[:r["n_bytes"]].encode()).hexdigest() for r in got)


def test_files_are_warc(spark):
    chunks = stored(warc.chunk_records(spark.createDataFrame([(1, "u", "x" * 150, "k")], PAGE), "page_id", "url", "html", 100), "t")
    path = shared_path(spark, "t")
    warc.write_archives(chunks, path)
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: continuation" in text and "WARC-Segment-Total-Length: 150" in text
    assert text.endswith("\r\n\r\n")


def test_empty(spark):
    assert warc.archive_pages(empty(spark, PAGE)).count() == 0
