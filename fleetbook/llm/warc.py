"""WARC archives through a chunked record table.

``chunk_records`` turns payload rows into rows (rec_id, chunk_no): every chunk is a slice of at
most ``CHUNK`` bytes with the SHA-256 of the payload up to its end, computed incrementally, so no
copy of a whole payload is made and no later step handles more than one chunk at a time.
``revisits`` finds payloads stored before; ``write_archives`` writes real WARC/1.1 files with
Spark's text writer, a payload of several chunks as a ``response`` segment followed by
``continuation`` segments; ``read_archives`` reads files back, one segment per row, checks
lengths and computes digests incrementally over the segments in order.

No segment contains the version line ``WARC/1.1\\r\\n`` (a chunk ends inside any that occurs in a
payload), so the line after a record end splits a file into its records exactly, wherever a file
is cut into input splits.

Defined cases: a null payload is empty; null URLs are written as ``urn:page:<id>``; control
characters and spaces of a URL are percent-encoded; repeated rows are records of their own, and
all rows that carry the smallest id of a payload are responses; payloads below ``MIN_REVISIT``
bytes are never revisits; an empty table writes no record.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.llm.common import shared_path, stored

CHUNK = 64 << 10
MIN_REVISIT = 100
VERSION = b"WARC/1.1\r\n"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

CHUNKS = "rec_id long, page_id long, uri string, chunk_no int, last boolean, n_bytes long, digest string, data binary"


def cuts(payload, chunk: int) -> list[int]:
    """Chunk ends: every ``chunk`` bytes, and one byte into any version line of the payload."""
    ends = set(range(chunk, len(payload), chunk))
    ends.update(m.start() + 1 for m in re.finditer(re.escape(VERSION), payload))
    ends.discard(len(payload))
    return [*sorted(ends), len(payload)]


def chunk_records(rows: DataFrame, key: str, uri: str, payload: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of ``payload`` (string or binary column)."""
    src = rows.select(F.monotonically_increasing_id().alias("rec_id"), F.col(key).cast("long").alias("page_id"),
                      F.col(uri).cast("string").alias("uri"), F.col(payload).cast("binary").alias("payload"))

    def run(batches):
        for batch in batches:
            ids, pages, uris = (batch.column(c).to_pylist() for c in ("rec_id", "page_id", "uri"))
            out, size = [], 0
            for i, value in enumerate(batch.column("payload")):
                buffer = value.as_buffer()
                view = memoryview(buffer) if buffer is not None else memoryview(b"")
                state, start = hashlib.sha256(), 0
                ends = cuts(view, chunk)
                for n, end in enumerate(ends):
                    piece = view[start:end]
                    state.update(piece)
                    out.append((ids[i], pages[i], uris[i], n, end == ends[-1], end, state.copy().hexdigest(), piece))
                    start, size = end, size + len(piece)
                    if size >= 4 << 20:
                        yield table(out)
                        out, size = [], 0
            if out:
                yield table(out)

    def table(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary())
        names = ("rec_id", "page_id", "uri", "chunk_no", "last", "n_bytes", "digest", "data")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return src.mapInArrow(run, CHUNKS)


def revisits(chunks: DataFrame) -> DataFrame:
    """(rec_id, refers_to, digest, total) of every record; refers_to is null for responses.

    Payloads that stand more than once are found by one aggregation and written as a table, so
    that the join back to the records is an ordinary one, which Spark splits where a payload is hot.
    """
    records = chunks.filter("last").select("rec_id", "page_id", "n_bytes", "digest")
    firsts = stored(records.filter(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest", "n_bytes")
                    .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
                    .select(F.col("digest").alias("d2"), F.col("n_bytes").alias("n2"), "first_id"), "warc-firsts")
    out = records.join(firsts, (F.col("digest") == F.col("d2")) & (F.col("n_bytes") == F.col("n2")), "left")
    refers = F.when(F.col("first_id") != F.col("page_id"), F.col("first_id"))
    return out.select("rec_id", refers.alias("refers_to"), F.col("digest").alias("payload_digest"), F.col("n_bytes").alias("total"))


def _urn(*cols):
    """A record id: a UUID-shaped digest of the record's place."""
    h = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _clean_uri(uri, page_id):
    uri = F.coalesce(uri, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    for c in ("\r", "\n", "\t", " "):
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.regexp_replace(uri, r"[\x00-\x1f\x7f]", "%00")


def write_archives(chunks: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the chunk table (stored) as WARC files below ``path``.

    The segments of a record stand together and in order.  A revisit record has no payload: its
    chunks after the first are left out, the first is written empty.  ``compression``: gzip, as
    archives usually are (a file is one gzip member and is read by one task), or none.
    """
    decided = revisits(chunks)
    rows = chunks.join(decided.withColumnRenamed("rec_id", "r2"), F.col("rec_id") == F.col("r2")) \
        .filter(F.col("refers_to").isNull() | (F.col("chunk_no") == 0))
    again = F.col("refers_to").isNotNull()
    first = F.col("chunk_no") == 0
    kind = F.when(~first, "continuation").when(again, "revisit").otherwise("response")
    data = F.when(again, F.lit(b"")).otherwise(F.col("data"))
    split = ~again & ~(first & F.col("last"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    when = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise(F.lit(""))
    record = _urn(F.col("page_id"), F.col("rec_id"))
    head = F.concat(
        F.lit(VERSION.decode()), line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(first, record).otherwise(_urn(F.col("page_id"), F.col("rec_id"), F.col("chunk_no")))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", _clean_uri(F.col("uri"), F.col("page_id"))),
        line("X-Rec-ID", F.col("rec_id")),
        when(F.col("page_id").isNotNull(), line("X-Page-ID", F.coalesce("page_id", F.lit(0)))),
        when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("X-Payload-Length", F.col("total"))),
        when(again, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
             line("X-Refers-To-Page", F.coalesce("refers_to", F.lit(0)))),
        when(split, line("WARC-Segment-Number", F.col("chunk_no") + 1)),
        when(~first, line("WARC-Segment-Origin-ID", record)),
        when(~first & F.col("last"), line("WARC-Segment-Total-Length", F.col("total"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(data)), F.lit("\r\n"))
    value = F.concat(head.cast("binary"), data).cast("string")
    (rows.repartition("rec_id").sortWithinPartitions("rec_id", "chunk_no").select(value.alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path))


SEGMENTS = ("rec_id long, page_id long, uri string, kind string, segment int, whole boolean, refers_to long, "
            "told string, total long, length long, digest string, data binary")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record (segment) of the files below ``path``; a payload that is one
    segment is digested here, only segments of longer payloads keep their bytes."""
    raw = spark.read.option("lineSep", "\r\n\r\n" + VERSION.decode()).text(path).select(F.col("value").cast("binary"))

    def run(batches):
        for batch in batches:
            out = [parse(v.as_buffer()) for v in batch.column("value")]
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(),
                     pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = [x.split()[0] for x in SEGMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return raw.mapInArrow(run, SEGMENTS)


def parse(buffer):
    """One record as (rec_id, page_id, uri, kind, segment, whole, refers_to, told, total, length,
    digest, data); ``buffer`` starts after the version line, except at the start of a file."""
    raw = buffer.to_pybytes() if hasattr(buffer, "to_pybytes") else bytes(buffer)
    stop = raw.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in raw[:stop].decode("utf-8").split("\r\n") if ": " in x)
    length = int(head["Content-Length"])
    data = memoryview(raw)[stop + 4:stop + 4 + length]
    if len(data) != length:
        raise ValueError(f"record {head['WARC-Record-ID']}: {len(data)} of {length} bytes")
    segment = int(head.get("WARC-Segment-Number", 0))
    told = head.get("WARC-Payload-Digest", "sha256:").removeprefix("sha256:") or None
    page = head.get("X-Page-ID")
    refers = head.get("X-Refers-To-Page")
    return (int(head["X-Rec-ID"]), int(page) if page else None, head["WARC-Target-URI"], head["WARC-Type"], segment,
            segment == 0, int(refers) if refers else None, told, int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None,
            length, hashlib.sha256(data).hexdigest() if segment == 0 else None, data if segment else None)


RECORDS = ("rec_id long, page_id long, uri string, kind string, payload_bytes long, payload_digest string, "
           "refers_to long, told string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: its payload's length and digest, over all segments.

    Segments of long payloads meet, in order, in one task and are digested one by one; a revisit
    carries the length and digest that its header tells.  A digest that differs from the one in
    the record's header raises an error.
    """
    parts = read_segments(spark, path)
    ordered = parts.repartition("rec_id").sortWithinPartitions("rec_id", "segment")

    def run(batches):
        state, length, head = None, 0, None
        done = []
        for batch in batches:
            for row in rows(batch):
                if row["whole"]:
                    again = row["kind"] == "revisit"
                    done.append(result(row, row["total"] if again else row["length"], row["told"] if again else row["digest"]))
                    continue
                if row["kind"] != "continuation":
                    if head is not None:
                        done.append(result(head, length, state.hexdigest()))
                    state, length, head = hashlib.sha256(), 0, row
                if head is None or head["rec_id"] != row["rec_id"]:
                    raise ValueError(f"segment of record {row['rec_id']} without its start")
                state.update(row["data"].as_buffer())
                length += row["length"]
            if done:
                yield pack(done)
                done = []
        if head is not None:
            yield pack([result(head, length, state.hexdigest())])

    def rows(batch):
        names = [c for c in batch.schema.names if c != "data"]
        plain = batch.select(names).to_pylist()
        for row, data in zip(plain, batch.column("data")):
            row["data"] = data
            yield row

    def result(row, length, digest):
        if digest != row["told"] or length != row["total"]:
            raise ValueError(f"record {row['rec_id']}: payload differs from its header")
        return (row["rec_id"], row["page_id"], row["uri"], row["kind"], length, digest, row["refers_to"], row["told"])

    def pack(done):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)],
                                          names=[x.split()[0] for x in RECORDS.split(", ")])

    return ordered.mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives in the shared folder and read them."""
    spark = pages.sparkSession
    chunks = stored(chunk_records(pages, "page_id", "url", "html", chunk), "warc-chunks")
    path = shared_path(spark, "warc")
    write_archives(chunks, path)
    return read_archives(spark, path)
