"""Language-model scores from an Elias-Fano coded bigram trie.

Training tokens are counted over all documents outside the held-out part.  Words are routed by
hash to slots, which count them and number them; bigrams are routed by both ids, so a word that
a third of the text consists of is spread over all slots.  A slot's task builds its part of the
trie: contexts and successor lists as Elias-Fano sequences (pointers into the successor level,
and successors relative to their context, are monotone), counts as 16-bit logarithms.  The levels
are written to one file, memory-mapped, and queried by successor search inside the context.

The model interpolates the bigram estimate with the smoothed unigram,
p(w | v) = k c(vw) / c(v) + (1 - k) p(w); k depends on the size of c(v) and is the grid value
with the best leave-one-out likelihood of all training tokens, summed over the slots.

Defined cases: null text is empty and consists of the end token; a null id counts as the empty
text for the held-out rule; without training tokens all probabilities are those of unseen words;
repeated rows are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetbook.llm import blocks as B
from fleetbook.llm.common import LOWER, U64, batch_bytes, mix64, prefix_hash, span_hash, tokens

ADD = 0.1
HELD_OUT_MOD = 10
END = U64(0xE0D0E0D0E0D0E0D1)
PIECE = 2 << 20
SLOTS_PER_TASK = 2
LOOKUP = 1 << 17                # bigrams looked up at once
GRID = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98])
SIZES = 24                     # context sizes 1, 2-3, 4-7, ..
LOG_STEP = 4096                # a count is kept as round(log10(count) * LOG_STEP) + 1


# ------------------------------------------------------------------------- Elias-Fano levels

class EliasFano:
    """A non-decreasing sequence: low bits in an array of 0, 1, 2 or 4 bytes each, high bits in unary."""

    KINDS = {0: np.uint8, 8: np.uint8, 16: np.dtype("<u2"), 32: np.dtype("<u4")}

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, dtype=self.KINDS[low_bits])
        bits = np.unpackbits(high)
        self.ones = np.flatnonzero(bits)[:n]
        self.zeros = np.flatnonzero(bits == 0)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        best = (top // max(n, 1)).bit_length() - 1
        low_bits = next((b for b in (0, 8, 16) if b >= best - 3), 32)
        low = (values & U64((1 << low_bits) - 1)).astype(EliasFano.KINDS[low_bits]) if low_bits else np.zeros(0, np.uint8)
        high = (values >> U64(low_bits)).astype(np.int64)
        unary = np.zeros(n + (int(high[-1]) if n else 0) + 2, dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        return n, low_bits, low.view(np.uint8), np.packbits(unary)

    def lows(self, at: np.ndarray) -> np.ndarray:
        return self.low[at].astype(U64) if self.low_bits else np.zeros(len(at), dtype=U64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.ones[at] - at).astype(U64) << U64(self.low_bits)) | self.lows(at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: successor search among the entries with its high bits."""
        high = (x >> U64(self.low_bits)).astype(np.int64)
        low = x & U64((1 << self.low_bits) - 1)
        inside = high < len(self.zeros)
        h = np.where(inside, high, 0)
        at = np.where(h > 0, self.zeros[np.maximum(h - 1, 0)] - (h - 1), 0)
        end = np.where(inside, np.minimum(self.zeros[h] - h, self.n), at)
        out = np.full(len(x), -1, dtype=np.int64)
        live = np.flatnonzero(inside & (at < end))
        left, right = at.copy(), end.copy()
        while len(live):                       # binary search for the first low part not below
            mid = (left[live] + right[live]) >> 1
            below = self.lows(mid) < low[live]
            left[live[below]] = mid[below] + 1
            right[live[~below]] = mid[~below]
            live = live[left[live] < right[live]]
        ok = np.flatnonzero(inside & (left < end))
        ok = ok[self.lows(left[ok]) == low[ok]]
        out[ok] = left[ok]
        return out


class Trie:
    """Two levels below the root: contexts, and per context its successors with coded counts."""

    def __init__(self, file):
        head = np.memmap(file, dtype=np.int64, mode="r", shape=(16,))
        at, levels = 128, []
        for k in range(3):
            n, bits, low, high = (int(x) for x in head[4 * k:4 * k + 4])
            a = np.memmap(file, dtype=np.uint8, mode="r", offset=at, shape=(low,)) if low else np.zeros(0, np.uint8)
            b = np.memmap(file, dtype=np.uint8, mode="r", offset=at + low, shape=(high,))
            levels.append(EliasFano(n, bits, a, b))
            at += low + high
        self.contexts, self.pointers, self.successors = levels
        self.span = U64(head[12])
        at += at % 2
        n = self.successors.n
        self.codes = np.memmap(file, dtype=np.uint16, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, np.uint16)

    @staticmethod
    def write(file, v: np.ndarray, w: np.ndarray, count: np.ndarray) -> None:
        """Write the levels for bigrams sorted by (v, w)."""
        new = np.ones(len(v), dtype=bool)
        new[1:] = v[1:] != v[:-1]
        start = np.flatnonzero(new)
        place = np.cumsum(new) - 1
        span = int(w.max()) + 1 if len(w) else 1
        relative = place.astype(U64) * U64(span) + w           # successors relative to their context
        levels = [EliasFano.encode(x.astype(U64)) for x in (v[start], np.append(start, len(v)), relative)]
        head = np.zeros(16, dtype=np.int64)
        for k, (n, bits, low, high) in enumerate(levels):
            head[4 * k:4 * k + 4] = n, bits, len(low), len(high)
        head[12] = span
        body = head.tobytes() + b"".join(low.tobytes() + high.tobytes() for _, _, low, high in levels)
        file.write(body + b"\0" * (len(body) % 2))
        file.write((np.rint(np.log10(count) * LOG_STEP).astype(np.uint16) + 1).tobytes())
        file.flush()

    def lookup(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Coded count of each bigram, 0 if it is not there."""
        out = np.zeros(len(v), dtype=np.uint16)
        if not self.successors.n:
            return out
        context = self.contexts.find(v)
        known = np.flatnonzero((context >= 0) & (w < self.span))
        c = context[known]
        at = self.successors.find(c.astype(U64) * self.span + w[known])
        inside = (at >= self.pointers.get(c).astype(np.int64)) & (at < self.pointers.get(c + 1).astype(np.int64))
        out[known[inside]] = self.codes[at[inside]]
        return out


# ----------------------------------------------------------------------------- blocks of text

class Stream:
    """The tokens of a block: every document's words and its end."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        n = len(self.ids)
        self.held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % HELD_OUT_MOD == 0 for i in self.ids], dtype=bool)
        docs, words = [], []
        start = 0
        column = table.column("text").combine_chunks()
        sizes = np.diff(batch_bytes(column)[1])
        while start < n:                                  # hash some megabytes at a time
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), PIECE)))
            data, offsets = batch_bytes(column.slice(start, stop - start))
            data = LOWER[data]
            doc, a, b = tokens(data, offsets)
            words.append(span_hash(prefix_hash(data), a, b))
            docs.append(doc + start)
            start = stop
        doc, word = np.concatenate([*docs, np.arange(n)]), np.concatenate([*words, np.full(n, END)])
        order = np.argsort(doc, kind="stable")             # the end comes after a document's words
        self.doc, word = doc[order], word[order]
        self.words, self.token = np.unique(word, return_inverse=True)
        first = np.ones(len(word), dtype=bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        self.before = np.empty(len(word), dtype=np.int64)   # context: the token before, or the start
        self.before[1:] = self.token[:-1]
        self.before[first] = len(self.words)
        self.train = ~self.held[self.doc]

    def word_order(self, slots: int):
        slot = word_slot(self.words, slots)
        order = np.lexsort((self.words, slot))
        return slot[order], order

    def known(self, replies, slots: int):
        """(count, id) of the block's words; the start of a text follows them as a context."""
        slot, order = self.word_order(slots)
        count, number = np.zeros(len(order) + 1, np.uint64), np.zeros(len(order) + 1, np.uint64)
        got = [B.unpack(r, np.uint64, np.uint64) for r in replies]
        count[order] = np.concatenate([g[0] for g in got])
        # the start of a text is as frequent as its end; ids begin at 1, so it has id 0
        number[order] = np.concatenate([g[1] for g in got]) * U64(slots) + slot.astype(U64) + U64(1)
        count[-1] = count[int(np.searchsorted(self.words, END))]
        return count, number

    def bigrams(self, number: np.ndarray, slots: int):
        """Distinct (context, token) pairs in the order they are asked, and each token's pair."""
        u = len(self.words) + 1
        pair, which = np.unique(self.before * u + self.token, return_inverse=True)
        v, w = pair // u, pair % u
        slot = (mix64(number[v] * U64(0x9E3779B97F4A7C15) + mix64(number[w])) % U64(slots)).astype(np.int64)
        order = np.lexsort((number[w], number[v], slot))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return slot[order], v[order], w[order], place[which]


def word_slot(words: np.ndarray, slots: int) -> np.ndarray:
    return ((words >> U64(20)) % U64(slots)).astype(np.int64)


def ask_words(slots: int):
    def questions(table):
        s = Stream(table)
        count = np.bincount(s.token[s.train], minlength=len(s.words)).astype(np.uint64)
        slot, order = s.word_order(slots)
        for k, at in B.by_slot(slot, slots):
            yield k, B.pack(B.rises(s.words[order][at]), count[order][at])
    return questions


def answer_words(slots: int):
    def answers(data):
        parts = [B.unpack(d, np.uint64, np.uint64) for d in data]
        sizes = [len(p[0]) for p in parts]
        word = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        words, which = np.unique(word, return_inverse=True)
        count = np.zeros(len(words), dtype=np.uint64)
        np.add.at(count, which, np.concatenate([p[1] for p in parts]))
        slot = word_slot(words, slots)
        order = np.argsort(slot, kind="stable")
        begin = np.searchsorted(slot[order], np.arange(slots))
        number = np.empty(len(words), dtype=np.uint64)
        number[order] = (np.arange(len(words)) - begin[slot[order]]).astype(np.uint64)   # place in its slot
        edge = np.cumsum([0, *sizes])
        found = [B.pack(count[which[a:b]], number[which[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
        return found, [count.sum(), (count > 0).sum()]
    return answers


def size_code(count: np.ndarray) -> np.ndarray:
    """A count in one byte: exact to 127, then in steps of an eighth of a doubling."""
    big = 128 + np.floor(8 * (np.log2(np.maximum(count, 128).astype(float)) - 7))
    return np.where(count < 128, count, np.minimum(big, 255)).astype(np.uint8)


def size_value(code: np.ndarray) -> np.ndarray:
    return np.where(code < 128, code, 2.0 ** (7 + (code.astype(float) - 128 + 0.5) / 8))


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(count, 1).astype(float))), SIZES - 1).astype(np.int64)


def ask_bigrams(word_slots: int, slots: int):
    def questions(table, replies):
        s = Stream(table)
        count, number = s.known(replies, word_slots)
        slot, v, w, which = s.bigrams(number, slots)
        seen = np.bincount(which[s.train], minlength=len(v)).astype(np.uint32)
        cv, cw = size_code(count[v]), size_code(count[w])
        for k, at in B.by_slot(slot, slots):
            yield k, B.pack(B.rises(number[v[at]]), number[w[at]], seen[at], cv[at], cw[at])
    return questions


def answer_bigrams(n: float, v_size: float):
    def answers(data):
        parts = [B.unpack(d, np.uint64, np.uint64, np.uint32, np.uint8, np.uint8) for d in data]
        sizes = [len(p[0]) for p in parts]
        v = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        w, seen, cv, cw = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
        del parts
        order = np.lexsort((w, v))
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(seen[order].astype(np.int64), first)
        here = order[first][total > 0]
        total = total[total > 0]
        with tempfile.TemporaryFile() as file:
            Trie.write(file, v[here], w[here], total)
            trie = Trie(file)
            found = np.concatenate([trie.lookup(v[a:a + LOOKUP], w[a:a + LOOKUP]) for a in range(0, len(v), LOOKUP)])
            del trie
        edge = np.cumsum([0, *sizes])
        sums = left_out_likelihood(total, cv[here], cw[here], n, v_size)
        return [B.pack(found[a:b]) for a, b in zip(edge[:-1], edge[1:])], sums.ravel()
    return answers


def unigram(count, n: float, v_size: float):
    return (count + ADD) / (n + ADD * (v_size + 1))


def left_out_likelihood(count, cv, cw, n: float, v_size: float) -> np.ndarray:
    """SIZES x GRID: log likelihood of the training tokens, each left out of its own bigram count."""
    out = np.zeros((SIZES, len(GRID)))
    if not len(count):
        return out
    c, context = count.astype(float), np.maximum(size_value(cv), count)
    rest = np.where(context > 1, (c - 1) / np.maximum(context - 1, 1), 0.0)
    base = unigram(size_value(cw), n, v_size)
    at = bucket(context)
    for k, g in enumerate(GRID):
        out[:, k] = np.bincount(at, weights=c * np.log10(g * rest + (1 - g) * base), minlength=SIZES)
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): SCORES."""
    blocks = B.build_blocks(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), ["doc_id", "text"])
    tasks = B.answer_tasks(docs)
    slots = SLOTS_PER_TASK * tasks
    words = B.answer(B.ask(blocks, ask_words(slots)), tasks, answer_words(slots))
    n, v_size = B.total_sums(words, 2)
    bigrams = B.answer(B.ask(B.with_replies(blocks, words), ask_bigrams(slots, slots)), tasks, answer_bigrams(n, v_size))
    fit = np.array(B.total_sums(bigrams, SIZES * len(GRID))).reshape(SIZES, len(GRID))
    weight = GRID[np.argmax(fit, axis=1)]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                s = Stream(B.documents_of(batch.column("docs")[i]))
                replies = [B.read_replies(batch.column(f"replies{k}")[i]) for k in (0, 1)]
                count, number = s.known(replies[0], slots)
                _, _, _, which = s.bigrams(number, slots)
                code = np.concatenate([B.unpack(r, np.uint16)[0] for r in replies[1]])[which]
                c, context = count[s.token].astype(float), count[s.before].astype(float)
                base = unigram(c, n, v_size)
                pair = np.where(code > 0, 10.0 ** ((code.astype(float) - 1) / LOG_STEP), 0.0)
                k = np.where(context > 0, weight[bucket(context)], 0.0)
                p = k * np.minimum(pair / np.maximum(context, 1), 1.0) + (1 - k) * base
                docs_n = len(s.ids)
                add = lambda x: np.bincount(s.doc, weights=x, minlength=docs_n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.ids, pa.int64()), pa.array(s.held), pa.array(np.bincount(s.doc, minlength=docs_n).astype(np.int64)),
                     pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(docs_n, int(n), np.int64)),
                     pa.array(add(np.log10(base))), pa.array(add(np.log10(p)))],
                    names=[x.split()[0] for x in SCORES.split(", ")])

    return B.with_replies(blocks, words, bigrams).mapInArrow(run, SCORES)
