"""Substring deduplication by fixed-block anchors: remove every word that lies in a window of
``WINDOW`` words whose word sequence starts anywhere else as well.

The index holds the non-overlapping blocks of ``BLOCK`` words of every text (words 0-17, 18-35, ..).
Since ``WINDOW`` is ``2 * BLOCK - 1``, each window contains exactly one block of its own text, and
wherever else the window stands, that block is met by a rolling window of the other text.  So

1. every rolling window of ``BLOCK`` words of every text probes the index; a block is *hit* if its
   words stand at two places or more;
2. a hit is extended in each of the ``BLOCK`` ways that make it a whole window (j words to the left,
   ``BLOCK - 1 - j`` to the right).  Extensions are compared as classes of equal word sequences, not
   pair by pair: a class of two or more is a repeat, so a passage that a third of all documents
   share costs one entry per shard and no pairs;
3. neighbouring repeated windows join into the maximal exact repeats, the removed spans.

Shards are blocks of documents that ask hash slots (``blocks.py``); a shard sends a word sequence
once however often it holds it.  Blocks are compared by 52 bits of hash, which only decides what
is extended, and windows by 96 bits, which decides what is removed.

Defined cases: a null text has no words; texts of fewer than ``WINDOW`` words keep all of them;
every row is a text of its own, whatever its id (null and repeated ids too); texts longer than
``PIECE`` bytes are handled in pieces that overlap by ``WINDOW - 1`` words, so that memory
follows the piece; any other columns are carried along in the struct ``doc`` and cannot clash.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.llm import blocks as B
from fleetbook.llm.common import BASE, BASE_INV, U64, batch_bytes, mix64, powers, prefix_hash, span_hash, stored, tokens

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Text bytes of one piece.
PIECE = 1 << 20
SLOTS_PER_TASK = 2
#: Low hash bits of a block that are not sent.
SPARED = 12
BASE_2 = 0xD1342543DE82EF95
BASE_2_INV = pow(BASE_2, -1, 1 << 64)

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))


# ------------------------------------------------------------------------------------- pieces

def cut_text(data: bytes):
    """(piece, bytes of its core): cores follow each other; after the core come the next
    ``WINDOW - 1`` words, so each window of the text lies in the piece in whose core it starts."""
    at = 0
    while True:
        space = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        if space is None:
            yield data[at:], len(data) - at
            return
        end = last = space.start()
        for word in islice(_WORD.finditer(data, end), WINDOW - 1):
            last = word.end()
        yield data[at:last], end - at
        at = end


def pieces(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, rec, piece, pieces, core, text): a row per text, or per piece of a long text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), "text")
    schema = T.StructType([rows.schema["doc"], T.StructField("rec", T.LongType()), T.StructField("piece", T.IntegerType()),
                           T.StructField("pieces", T.IntegerType()), T.StructField("core", T.LongType()),
                           T.StructField("text", T.StringType())])

    def run(batches):
        rec = TaskContext.get().partitionId() << 33
        for batch in batches:
            size = batch.column("text").cast(pa.large_string())
            sizes = np.diff(np.frombuffer(size.buffers()[1], np.int64)[size.offset:size.offset + len(size) + 1])
            at = 0
            for long in [*np.flatnonzero(sizes > PIECE).tolist(), batch.num_rows]:   # short ones together
                part = batch.slice(at, long - at)
                n = part.num_rows
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc"), pa.array(np.arange(rec, rec + n)), pa.array(np.zeros(n, np.int32)),
                         pa.array(np.ones(n, np.int32)), pa.array(sizes[at:long]), part.column("text")], names=schema.names)
                    rec += n
                if long < batch.num_rows:
                    data = batch.column("text")[long].as_buffer().to_pybytes()
                    cuts = list(cut_text(data))
                    for k, (text, core) in enumerate(cuts):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc").slice(long, 1), pa.array([rec], pa.int64()), pa.array([k], pa.int32()),
                             pa.array([len(cuts)], pa.int32()), pa.array([core], pa.int64()),
                             pa.array([text.decode()], pa.string())], names=schema.names)
                    rec += 1
                at = long + 1

    return rows.mapInArrow(run, schema)


# -------------------------------------------------------------------------------------- shards

def rolling(code: np.ndarray, length: int, base: int, inverse: int) -> np.ndarray:
    """64-bit hash of each run of ``length`` word codes."""
    n = len(code)
    if n < length:
        return np.zeros(0, U64)
    prefix = np.zeros(n + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(code * powers(n, base), out=prefix[1:])
        return mix64((prefix[length:] - prefix[:-length]) * powers(n - length + 1, inverse))


class Distinct:
    """Distinct keys in ascending order: ``entry`` of every key, ``first`` place and ``many`` (held
    twice or more) of every entry."""

    def __init__(self, *keys: np.ndarray):
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        start = np.flatnonzero(new)
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[start]
        self.many = np.diff(np.append(start, len(order))) > 1
        self._order, self._start = order, start

    def any(self, flag: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flag[self._order], self._start) if len(self._start) else np.zeros(0, bool)


def slot_of(key: np.ndarray, slots: int) -> np.ndarray:
    """Slots are ranges of the 64-bit keys, so that keys sorted by slot rise."""
    return ((key >> U64(32)) * U64(slots) >> U64(32)).astype(np.int64)


class Shard:
    """The words of a block of texts; each text is followed by a space of its own."""

    def __init__(self, table: pa.Table):
        data, offsets = batch_bytes(table.column("text"))
        self.data = np.insert(data, offsets[1:], 0x20)
        self.offsets = offsets + np.arange(len(offsets))
        self.doc, self.start, self.end = tokens(self.data, self.offsets)
        self.first_word = np.searchsorted(self.doc, np.arange(len(offsets)))      # per text, and the end
        self.code = span_hash(prefix_hash(self.data), self.start, self.end)
        self.place = np.arange(len(self.doc)) - self.first_word[self.doc]

    def _inside(self, length: int) -> np.ndarray:
        """Starts of the runs of ``length`` words of one text."""
        n = len(self.doc) - length + 1
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1:]) if n > 0 else np.zeros(0, np.int64)

    def blocks(self):
        """(starts, keys as sent, their Distinct) of all rolling windows of ``BLOCK`` words."""
        at = self._inside(BLOCK)
        key = rolling(self.code, BLOCK, BASE, BASE_INV)[at] if len(at) else np.zeros(0, U64)
        key = key >> U64(SPARED) << U64(SPARED)
        return at, key, Distinct(key)

    def extensions(self, replies):
        """(starts, keys, second keys, their Distinct) of the windows around the blocks that were hit."""
        at, _, seen = self.blocks()
        hit = np.zeros(len(self.doc) + BLOCK, dtype=bool)
        if len(at):
            hit[at] = read_codes(replies, len(seen.first))[seen.entry] > 0
        window = self._inside(WINDOW)
        window = window[hit[window + (-self.place[window]) % BLOCK]]
        if not len(window):
            none = np.zeros(0, U64)
            return window, none, none.astype(np.uint32), Distinct(none, none)
        one = rolling(self.code, WINDOW, BASE, BASE_INV)[window]
        two = (rolling(mix64(self.code ^ U64(BASE_2)), WINDOW, BASE_2, BASE_2_INV)[window] >> U64(32)).astype(np.uint32)
        return window, one, two, Distinct(one, two)


def read_codes(replies, n: int) -> np.ndarray:
    return np.concatenate([B.unpack(r, np.uint8)[0] for r in replies]) if replies else np.zeros(n, np.uint8)


def ask_blocks(slots: int):
    """A shard's distinct rolling windows; bit 0: held twice or more here, bit 1: in the index."""
    def questions(table):
        shard = Shard(table)
        at, key, seen = shard.blocks()
        flag = seen.many.astype(np.uint8) | (seen.any(shard.place[at] % BLOCK == 0).astype(np.uint8) << 1)
        key = key[seen.first]
        for k, part in B.by_slot(slot_of(key, slots), slots):
            yield k, B.pack(B.rises(key[part] >> U64(SPARED)), flag[part])
    return questions


def _answers(codes: np.ndarray, sizes: list[int]) -> list[bytes]:
    edge = np.cumsum([0, *sizes])
    return [B.pack(codes[a:b].astype(np.uint8)) for a, b in zip(edge[:-1], edge[1:])]


def answer_blocks(data):
    """Per rolling window 1 if its words are a block of some text and stand at two places or more."""
    parts = [B.unpack(d, np.uint64, np.uint8) for d in data]
    key = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
    flag = np.concatenate([p[1] for p in parts])
    seen = Distinct(key)
    hit = seen.any(flag & 2 > 0) & (seen.many | seen.any(flag & 1 > 0))
    return _answers(hit[seen.entry], [len(p[0]) for p in parts]), [float(hit.sum())]


def ask_windows(slots: int):
    """A shard's distinct extended windows; flag: held twice or more here."""
    def questions(table, replies):
        _, one, two, seen = Shard(table).extensions(replies)
        one, two, flag = one[seen.first], two[seen.first], seen.many.astype(np.uint8)
        for k, part in B.by_slot(slot_of(one, slots), slots):
            yield k, B.pack(B.rises(one[part]), two[part], flag[part])
    return questions


def answer_windows(data):
    """Per window 1 if its class has two members or more."""
    parts = [B.unpack(d, np.uint64, np.uint32, np.uint8) for d in data]
    one = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
    two = np.concatenate([p[1] for p in parts])
    seen = Distinct(one, two)
    many = seen.many | seen.any(np.concatenate([p[2] for p in parts]) > 0)
    return _answers(many[seen.entry], [len(p[0]) for p in parts]), [float(many.sum())]


# ------------------------------------------------------------------------------------- removal

def removed_words(shard: Shard, replies) -> np.ndarray:
    """Which words lie in a repeated window."""
    window, _, _, seen = shard.extensions(replies[0])
    change = np.zeros(len(shard.doc) + 1, dtype=np.int64)
    if len(window):
        hit = window[read_codes(replies[1], len(seen.first))[seen.entry] > 0]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def spans_of(gone: np.ndarray, first_word: np.ndarray):
    """(text, first word, word after the last) of the removed runs; runs end with their text."""
    doc = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    edge = np.ones(len(gone) + 1, dtype=bool)
    if len(gone):
        edge[1:-1] = (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(edge[:-1] & gone)
    end = np.flatnonzero(edge[1:] & gone) + 1
    return doc[start], start - first_word[doc[start]], end - first_word[doc[start]]


def kept_texts(shard: Shard, gone: np.ndarray):
    """(bytes, offsets per text): the kept words of each text, joined by one space."""
    data = shard.data.copy()
    data[shard.end] = 0x20
    change = np.zeros(len(data) + 2, dtype=np.int8)
    start, end, doc = shard.start[~gone], shard.end[~gone], shard.doc[~gone]
    last = np.ones(len(doc), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    change[start] += 1
    np.add.at(change, end + ~last, -1)                     # the space goes along, but for the last word's
    keep = np.cumsum(change[:-2], dtype=np.int32) > 0
    size = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], size[shard.offsets]


FIELDS = [T.StructField("words", T.LongType()), T.StructField("removed", T.LongType()),
          T.StructField("spans", SPANS), T.StructField("text", T.StringType())]
PART = [T.StructField("rec", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("part", T.BinaryType())]


def _spans_array(doc, start, end, n: int) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["first_word", "end_word"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def _finished(doc_column, words, removed, spans, texts, names) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [doc_column, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), spans, texts,
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)


def cleaned(blocks: DataFrame, doc_field: T.StructField) -> DataFrame:
    """Finished texts, and the parts of long texts (``rec``, ``piece`` and ``part`` not null)."""
    schema = T.StructType([doc_field, *FIELDS, *PART])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = B.documents_of(batch.column("docs")[i])
                shard = Shard(table)
                gone = removed_words(shard, [B.read_replies(batch.column(f"replies{k}")[i]) for k in (0, 1)])
                data, offsets = kept_texts(shard, gone)
                n = table.num_rows
                texts = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
                dropped = np.concatenate([[0], np.cumsum(gone)])[shard.first_word]
                whole = _finished(table.column("doc").combine_chunks(), np.diff(shard.first_word), np.diff(dropped),
                                  _spans_array(*spans_of(gone, shard.first_word), n), texts, schema.names)
                single = table.column("pieces").to_numpy() == 1
                yield whole if single.all() else whole.filter(pa.array(single))
                for d in np.flatnonzero(~single).tolist():
                    core = table.column("core")[d].as_py()
                    a, b = shard.first_word[d:d + 2].tolist()
                    inner = a + int(np.searchsorted(shard.start[a:b], shard.offsets[d] + core))
                    text = shard.data[shard.offsets[d]:shard.offsets[d] + core].tobytes()
                    part = B.squeeze((inner - a).to_bytes(8, "little") + (b - a).to_bytes(8, "little")
                                     + np.packbits(gone[a:b]).tobytes() + text)
                    yield pa.RecordBatch.from_arrays(
                        [table.column("doc").combine_chunks().slice(d, 1), *[pa.nulls(1, k) for k in (pa.int64(), pa.int64(), ARROW_SPANS, pa.string())],
                         pa.array([table.column("rec")[d].as_py()], pa.int64()), pa.array([table.column("piece")[d].as_py()], pa.int32()),
                         pa.array([part], pa.binary())], names=schema.names)

    return blocks.mapInArrow(run, schema)


class LongText:
    """A long text put together again from its parts, in order."""

    def __init__(self, doc):
        self.doc, self.carry, self.gone, self.kept = doc, np.zeros(0, bool), [], []

    def add(self, part: bytes) -> None:
        raw = B.unsqueeze(part)
        inner, n = (int.from_bytes(raw[k:k + 8], "little") for k in (0, 8))
        edge = 16 + (n + 7) // 8
        mask = np.unpackbits(np.frombuffer(raw, np.uint8, edge - 16, 16), count=n).astype(bool) if n else np.zeros(0, bool)
        size = max(len(mask), len(self.carry))
        whole = np.zeros(size, dtype=bool)
        whole[:n] = mask
        whole[:len(self.carry)] |= self.carry                # windows of the pieces before reach in here
        gone, self.carry = whole[:inner], whole[inner:]
        self.gone.append(gone)
        self.kept.append(b" ".join(w for w, g in zip(raw[edge:].split(), gone.tolist()) if not g))

    def row(self, names) -> pa.RecordBatch:
        gone = np.concatenate(self.gone)
        text = b" ".join(k for k in self.kept if k)
        return _finished(self.doc, [len(gone)], [int(gone.sum())], _spans_array(*spans_of(gone, np.array([0, len(gone)])), 1),
                         pa.array([text.decode()], pa.string()), names)


def joined(parts: DataFrame) -> DataFrame:
    """Long texts from their parts, one text after the other."""
    schema = parts.schema

    def run(batches):
        now, open_text = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                rec = batch.column("rec")[i].as_py()
                if rec != now:
                    if open_text is not None:
                        yield open_text.row(schema.names)
                    now, open_text = rec, LongText(batch.column("doc").slice(i, 1))
                open_text.add(batch.column("part")[i].as_py())
        if open_text is not None:
            yield open_text.row(schema.names)

    return parts.repartition("rec").sortWithinPartitions("rec", "piece").mapInArrow(run, schema)


def remove_passages(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, words, removed, spans, text): ``doc`` holds ``columns`` of ``docs``; ``words`` and
    ``removed`` count words, ``spans`` are the maximal removed runs of words, ``text`` is what is
    left, joined by one space."""
    rows = pieces(docs, columns)
    blocks = B.build_blocks(rows, rows.columns)
    tasks = B.answer_tasks(docs)
    slots = SLOTS_PER_TASK * tasks
    first = B.answer(B.ask(blocks, ask_blocks(slots)), tasks, answer_blocks)
    second = B.answer(B.ask(B.with_replies(blocks, first), ask_windows(slots)), tasks, answer_windows)
    out = stored(cleaned(B.with_replies(blocks, first, second), rows.schema["doc"]), "cleaned")
    asked = ["doc", "words", "removed", "spans", "text"]
    return out.filter("rec is null").select(*asked).unionByName(joined(out.filter("rec is not null")).select(*asked))
