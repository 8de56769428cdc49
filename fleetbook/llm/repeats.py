"""Suffix-array deduplication: remove the bytes of every 50-byte string that also starts in a
document with a smaller id.

Shards are blocks of documents.  Which shards have to be compared on which text is found by
anchors: every 50-byte window is anchored by its leftmost smallest 24-byte gram, consecutive
windows with one anchor form a segment, and equal windows always lie in segments with equal
grams.  A shard asks the slot of each gram about its distinct segments:

* a segment whose smallest document is elsewhere (or another one of the shard) is removed whole;
* where segments of one gram differ, the document that holds a segment first has to be compared
  window by window.  The shard builds a suffix array over that text (Larsson-Sadakane refinement),
  takes common prefixes (Kasai) and so its distinct 50-byte strings with their smallest document;
  these are merged across shards by binary search in the sorted strings of a slot, compared by
  96-bit hashes.

Every window is decided, however many documents hold it: a string costs one entry per shard.

Defined cases: null text is empty; documents of fewer than 50 bytes keep everything; repeated
ids do not remove from each other; a null id counts as larger than any other; texts of any
length are cut into pieces for the anchors only; other columns are carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.llm import blocks as B
from fleetbook.llm.common import U64, batch_bytes, mix64, prefix_hash, span_hash
from fleetbook.llm.suffixes import LENGTH, equal_runs, windows

PIECE = 1 << 20
LAST_ID = np.iinfo(np.int64).max
SLOTS_PER_TASK = 2


class Shard:
    """The documents of a block and the segments of their windows."""

    def __init__(self, table: pa.Table):
        column = table.column("doc_id").cast(pa.int64())
        self.ids = column.fill_null(LAST_ID).to_numpy()
        self.data, self.offsets = batch_bytes(table.column("text"))
        self.prefix = prefix_hash(self.data)
        found = [self._windows(*p) for p in self._pieces()]
        self.doc, self.start, self.width, self.gram = (np.concatenate(x) for x in zip(*found))
        seg = span_hash(self.prefix, self.start, self.start + self.width + LENGTH - 1) >> U64(16)
        order = np.lexsort((seg, self.gram))
        g, s = self.gram[order], seg[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        self.entry = np.empty(len(order), dtype=np.int64)          # entry of each segment occurrence
        self.entry[order] = np.cumsum(new) - 1
        self.entry_gram, self.entry_seg = g[first], s[first]
        owner = self.ids[self.doc]
        self.entry_doc = np.minimum.reduceat(owner[order], first) if len(first) else np.zeros(0, np.int64)
        self.owner = owner

    def _pieces(self):
        n = len(self.data)
        return [(a, min(n, a + PIECE + LENGTH - 1)) for a in range(0, max(n, 1), PIECE)]

    def _windows(self, a, b):
        offsets = np.clip(self.offsets, a, b) - a
        doc, start, width, gram = windows(self.data[a:b], offsets, prefix_hash(self.data[a:b]))
        return doc, start + a, width, gram

    def slot_order(self, slots: int):
        slot = (mix64(self.entry_gram) % U64(slots)).astype(np.int64)
        order = np.lexsort((self.entry_seg, self.entry_gram, slot))
        return slot[order], order

    def codes(self, replies, slots: int) -> np.ndarray:
        """Answered code of every entry."""
        _, order = self.slot_order(slots)
        out = np.zeros(len(order), dtype=np.uint8)
        if replies:
            out[order] = np.concatenate([B.unpack(r, np.uint8)[0] for r in replies])
        return out

    def decide(self, codes: np.ndarray):
        """(segments removed whole, segments to compare by window), as masks over occurrences."""
        code = codes[self.entry]
        gone = ((code & 1) > 0) | (self.owner > self.entry_doc[self.entry])
        return gone, ~gone & ((code & 2) > 0)

    def open_windows(self, compare: np.ndarray) -> np.ndarray:
        """Starts of the windows of the segments to compare."""
        start, width = self.start[compare], self.width[compare]
        return np.sort(np.repeat(start - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())) \
            if len(start) else np.zeros(0, np.int64)

    def window_owner(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets, at, side="right") - 1]

    def string_hash(self, at: np.ndarray):
        return span_hash(self.prefix, at, at + LENGTH), second_hash(self.data, at)

    def own_strings(self, at: np.ndarray):
        """Distinct strings of the open windows by suffix array: (one start, smallest document)."""
        if not len(at):
            return at, at
        gap = np.flatnonzero(np.diff(at) > LENGTH)                 # pieces of text around the windows
        lo, hi = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + LENGTH
        text = np.concatenate([self.data[a:b] for a, b in zip(lo, hi)])
        moved = np.concatenate([[0], np.cumsum(hi - lo)[:-1]])
        piece = np.searchsorted(lo, at, side="right") - 1
        local = at - lo[piece] + moved[piece]
        order, run = equal_runs(text)
        run_of = np.empty(len(text), dtype=np.int64)
        run_of[order] = run
        mine = run_of[local]
        by = np.lexsort((self.window_owner(at), mine))
        first = np.ones(len(by), dtype=bool)
        first[1:] = mine[by][1:] != mine[by][:-1]
        pick = by[first]
        return at[pick], self.window_owner(at[pick])


def second_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another 32 bits of hash of the strings at ``at``, by their words rather than their bytes."""
    out = np.full(len(at), U64(0xABCDEF))
    with np.errstate(over="ignore"):
        for k in range(0, LENGTH, 8):
            word = np.zeros(len(at), dtype=U64)
            for j in range(k, min(k + 8, LENGTH)):
                word = (word << U64(8)) | data[at + j].astype(U64)
            out = mix64(out * U64(31) + mix64(word + U64(k)))
    return (out >> U64(32)).astype(np.uint32)


def _string_slots(h1: np.ndarray, slots: int) -> np.ndarray:
    return (h1 >> U64(40)).astype(np.int64) % slots


def ask_segments(slots: int):
    def questions(table):
        shard = Shard(table)
        slot, order = shard.slot_order(slots)
        g, s, d = shard.entry_gram[order], shard.entry_seg[order], shard.entry_doc[order]
        for k, at in B.by_slot(slot, slots):
            yield k, B.pack(B.rises(g[at]), s[at], d[at])
    return questions


def _split(found: np.ndarray, sizes: list[int]) -> list[bytes]:
    edge = np.cumsum([0, *sizes])
    return [B.pack(found[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def answer_segments(data):
    """Per entry 1: a smaller document holds the segment; 2: compare its windows."""
    parts = [B.unpack(d, np.uint64, np.uint64, np.int64) for d in data]
    sizes = [len(p[0]) for p in parts]
    g = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
    s, d = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    order = np.lexsort((s, g))
    g, s = g[order], s[order]
    new_gram = np.ones(len(g), dtype=bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_seg = new_gram.copy()
    new_seg[1:] |= s[1:] != s[:-1]
    seg = np.cumsum(new_seg) - 1
    low = np.minimum.reduceat(d[order], np.flatnonzero(new_seg))          # smallest document of each segment
    gram_of_seg = (np.cumsum(new_gram) - 1)[new_seg]
    begin = np.flatnonzero(np.append(True, gram_of_seg[1:] != gram_of_seg[:-1]))
    mixed = np.minimum.reduceat(low, begin) < np.maximum.reduceat(low, begin)   # several segments, several documents
    elsewhere = low[seg] < d[order]
    compare = mixed[gram_of_seg[seg]] & ~elsewhere
    code = np.empty(len(g), dtype=np.uint8)
    code[order] = elsewhere.astype(np.uint8) | (compare.astype(np.uint8) << 1)
    return _split(code, sizes), [len(g)]


def ask_strings(slots: int):
    def questions(table, replies):
        shard = Shard(table)
        _, compare = shard.decide(shard.codes(replies, slots))
        at, low = shard.own_strings(shard.open_windows(compare))
        h1, h2 = shard.string_hash(at)
        slot = _string_slots(h1, slots)
        order = np.lexsort((h2, h1, slot))
        slot, h1, h2, low = slot[order], h1[order], h2[order], low[order]
        for k, part in B.by_slot(slot, slots):
            yield k, B.pack(B.rises(h1[part]), h2[part], low[part])
    return questions


def answer_strings(data):
    """Per string 1 if another shard holds it in a smaller document.

    The strings of all shards are merged into one sorted table; each shard's strings are found in
    it by binary search.
    """
    parts = [B.unpack(d, np.uint64, np.uint32, np.int64) for d in data]
    sizes = [len(p[0]) for p in parts]
    h1 = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
    h2, low = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(low[order], first)
    merged = a[first]
    at = np.searchsorted(merged, h1)
    other = b[first]
    while True:                                # equal first hashes are told apart by the second
        wrong = other[at] != h2
        if not wrong.any():
            break
        at = at + wrong
    return _split((least[at] < low).astype(np.uint8), sizes), [len(h1)]


def removed_mask(shard: Shard, codes1: np.ndarray, replies2, slots: int) -> np.ndarray:
    """Which bytes of the shard are removed."""
    gone, compare = shard.decide(codes1)
    change = np.zeros(len(shard.data) + 1, dtype=np.int64)
    np.add.at(change, shard.start[gone], 1)
    np.add.at(change, shard.start[gone] + shard.width[gone] + LENGTH - 1, -1)
    at = shard.open_windows(compare)
    if len(at):
        h1, h2 = shard.string_hash(at)
        owner = shard.window_owner(at)
        order = np.lexsort((owner, h2, h1, _string_slots(h1, slots)))
        a, b, who = h1[order], h2[order], owner[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        string = np.cumsum(new) - 1
        code = np.concatenate([B.unpack(r, np.uint8)[0] for r in replies2])
        hit = at[order][(code[string] > 0) | (who > who[new][string])]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


MEASURES = [T.StructField("rp_bytes", T.LongType()), T.StructField("rp_removed", T.LongType()),
            T.StructField("rp_spans", T.LongType()), T.StructField("rp_sha256", T.StringType())]


def remove_repeats(docs: DataFrame, columns: list[str], texts: bool = False) -> DataFrame:
    """``columns`` of ``docs`` (doc_id among them) with rp_bytes, rp_removed, rp_spans and
    rp_sha256 of the remaining bytes; with ``texts`` also rp_text, the remaining text (a character
    of which a byte was removed is left out)."""
    keep = [c for c in columns if c != "text"]
    blocks = B.build_blocks(docs, [*keep, "text"])
    tasks = B.answer_tasks(docs)
    slots = SLOTS_PER_TASK * tasks
    first = B.answer(B.ask(blocks, ask_segments(slots)), tasks, answer_segments)
    second = B.answer(B.ask(B.with_replies(blocks, first), ask_strings(slots)), tasks, answer_strings)
    fields = [docs.schema[c] for c in keep] + MEASURES + ([T.StructField("rp_text", T.StringType())] if texts else [])
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = B.documents_of(batch.column("docs")[i])
                replies = [B.read_replies(batch.column(f"replies{k}")[i]) for k in (0, 1)]
                shard = Shard(table)
                gone = removed_mask(shard, shard.codes(replies[0], slots), replies[1], slots)
                out = []
                for d in range(table.num_rows):
                    a, b = shard.offsets[d], shard.offsets[d + 1]
                    mask = gone[a:b]
                    n = int(mask.sum())
                    left = shard.data[a:b] if not n else shard.data[a:b][~mask]
                    raw = left.tobytes()
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
                    row = (len(mask), n, spans, hashlib.sha256(raw).hexdigest())
                    out.append((*row, raw.decode("utf-8", errors="ignore")) if texts else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if texts else [])]
                cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                kept = [table.column(c).combine_chunks() for c in keep]
                whole = pa.Table.from_arrays([*kept, *cols], names=names)
                yield from whole.to_batches(max_chunksize=256)

    return B.with_replies(blocks, first, second).mapInArrow(run, T.StructType(fields))
