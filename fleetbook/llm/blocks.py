"""Blocks of documents that ask questions of hash slots.

Operators that look up many small keys per document (grams, words, strings) work on blocks: some
megabytes of documents, kept compressed as one row of a table in the shared folder.  A block asks
about its distinct keys, already added up inside the block; the questions of all blocks for one
slot meet in one task, are merged there and answered entry by entry, and the answers travel back
to the block.  So a key is sent once per block however often it stands there, slots are dealt out
by hash, and a key that a third of all documents hold costs a slot one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.llm.common import stored

#: Text bytes after which a block is closed.
BLOCK_BYTES = 3 << 20


#: Compression of the blocks themselves, which are read several times; answers use level 1.
BLOCK_LEVEL = 9


def squeeze(data, level: int = 1) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def unsqueeze(data) -> bytes:
    data = memoryview(data)
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, as bytes by significance, so that unused ones cost nothing."""
    parts = [np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(a), -1).T for a in arrays]
    return squeeze(b"".join(p.tobytes() for p in parts))


def unpack(data, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(unsqueeze(data), dtype=np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        planes = raw[at:at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def rises(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of an ascending array (the first against 0)."""
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


def build_blocks(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(block, docs): ``columns`` of ``docs`` (``text`` among them) in blocks, stored."""
    src = docs.select(*[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterable[pa.RecordBatch]):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()),
                                               pa.array([squeeze(sink.getvalue(), BLOCK_LEVEL)], pa.binary())], names=["block", "docs"])

        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                piece = batch.slice(start, 16)
                held.append(piece)
                size += piece.column("text").cast(pa.large_string()).nbytes
                if size >= BLOCK_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return stored(src.mapInArrow(run, "block long, docs binary"), "blocks")


def documents_of(value) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(value.as_buffer())).read_all().combine_chunks()


def ask(blocks: DataFrame, questions: Callable) -> DataFrame:
    """(slot, block, data): what ``questions(documents, replies)`` yields per block as (slot, bytes)."""
    names = [c for c in blocks.columns if c not in ("block", "docs")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                replies = [batch.column(n)[i] for n in names]
                block = batch.column("block")[i].as_py()
                out = list(questions(documents_of(batch.column("docs")[i]), *map(read_replies, replies)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s for s, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()),
                         pa.array([d for _, d in out], pa.binary())], names=["slot", "block", "data"])

    return blocks.mapInArrow(run, "slot int, block long, data binary")


#: Answering tasks per shuffle partition: they hold their questions in memory, so there are more.
TASKS_PER_PARTITION = 3


def answer_tasks(df: DataFrame) -> int:
    return TASKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def answer(asked: DataFrame, slots: int, answers: Callable, sums: int = 1) -> DataFrame:
    """(block, slot, data, sums): per question row the answer; the questions of a task's slots are
    handed to ``answers(list of bytes)`` together, which returns their answers and sums to add up."""
    def run(batches):
        slot, block, data = [], [], []
        for batch in batches:
            slot += batch.column("slot").to_pylist()
            block += batch.column("block").to_pylist()
            data += [d.as_buffer() for d in batch.column("data")]
        if not slot:
            return
        found, total = answers(data)
        del data
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.binary()),
             pa.array([list(map(float, total))], pa.list_(pa.float64()))], names=["block", "slot", "data", "sums"])
        for s in range(0, len(slot), 256):
            part = found[s:s + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[s:s + 256], pa.int64()), pa.array(slot[s:s + 256], pa.int32()), pa.array(part, pa.binary()),
                 pa.array([None] * len(part), pa.list_(pa.float64()))], names=["block", "slot", "data", "sums"])

    out = asked.repartition(slots, "slot").mapInArrow(run, "block long, slot int, data binary, sums array<double>")
    return stored(out, "answers")


def total_sums(answered: DataFrame, n: int) -> list[float]:
    """The sums that all tasks of ``answer`` returned, added up."""
    row = answered.filter("block = -1").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [x or 0.0 for x in row]


def with_replies(blocks: DataFrame, *answered: DataFrame) -> DataFrame:
    """``blocks`` with one column of replies for each table of answers."""
    for i, table in enumerate(answered):
        told = table.filter("block >= 0").groupBy(F.col("block").alias(f"b{i}")).agg(
            F.collect_list(F.struct("slot", "data")).alias(f"replies{i}"))
        blocks = blocks.join(told, F.col("block") == F.col(f"b{i}"), "left").drop(f"b{i}")
    return blocks


def read_replies(value) -> list[bytes]:
    """The answers to a block's questions, in the order of their slots."""
    if value is None or not value.is_valid:
        return []
    rows = value.values
    order = np.argsort(rows.field("slot").to_numpy(), kind="stable")
    data = rows.field("data")
    return [data[int(i)].as_buffer() for i in order]


def by_slot(slot: np.ndarray, slots: int) -> list[tuple[int, slice]]:
    """Ranges of an array sorted by slot."""
    edge = np.searchsorted(slot, np.arange(slots + 1))
    return [(s, slice(edge[s], edge[s + 1])) for s in range(slots) if edge[s + 1] > edge[s]]
