"""Helpers shared by the corpus operators: stored intermediate tables, Arrow batch bounds and
vectorised byte/token arithmetic for use inside tasks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.plans.session import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

#: Word pattern: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small (the default of 10,000 rows can be gigabytes of text)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder (all executors and the driver see it)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with a table every executor can re-read after a loss, and gives later
    joins a plain scan, so that Spark inserts its own exchanges, which it can split on skew.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ids(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose long ``column`` is in the one-column table ``ids`` (stored).

    Spark puts a Bloom filter of the ids, of fixed size, into the scan of ``rows``, so that long
    texts that nobody asks for are not shuffled.  It does so for a side that is filtered, hence the
    comparison, which every id passes.
    """
    rows.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    wanted = ids.select(F.col(ids.columns[0]).alias("wanted_id")).filter(F.col("wanted_id") >= F.lit(-2 ** 63).cast("long"))
    return rows.join(wanted, rows[column] == wanted["wanted_id"], "left_semi")


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col, mod: int):
    """crc32(id as text) modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


# ------------------------------------------------------------------------------------------
# Byte arithmetic inside tasks.  A batch of texts is one uint8 array plus document offsets.
# ------------------------------------------------------------------------------------------

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
        return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_CODE = _splitmix(256, 0x5EED)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        out = np.ones(size, dtype=U64)
        done = 1
        with np.errstate(over="ignore"):
            step = U64(base)
            while done < size:   # doubling: out[done:2*done] = out[:done] * base**done
                out[done:2 * done] = out[:done] * step
                step = step * step
                done *= 2
        _POWERS[base] = have = out
    return have[:n]


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n+1) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = int(offsets[0]) if len(offsets) else 0
    end = int(offsets[-1]) if len(offsets) else 0
    return data[start:end], offsets - start


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] = sum over j < i of code(data[j]) * BASE**j, modulo 2**64 (length n+1)."""
    out = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * powers(len(data), BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    with np.errstate(over="ignore"):
        inv = powers(len(prefix), BASE_INV)
        return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))


def tokens(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE):
    """Words of a batch: (document index, start, end), in order; words never cross documents and end
    at the bytes of ``gaps``."""
    space = gaps[data]
    first = np.ones(len(data) + 1, dtype=bool)      # does a new run begin here?
    if len(data):
        first[1:-1] = space[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = True
    start = np.flatnonzero(first[:-1] & ~space) if len(data) else np.zeros(0, np.int64)
    last = np.zeros(len(data), dtype=bool)
    if len(data):
        last[:-1] = space[1:]
        last[-1] = True
        last[cut - 1] = True
    end = np.flatnonzero(last & ~space) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, start, end
