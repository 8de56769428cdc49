"""Cross-tokenizer alignment: which tokens of a byte-level BPE vocabulary (A) and of a SentencePiece
model (B) stand for the same bytes, in how many documents, and how well each document's links agree
with the corpus.

Both tokenizers read the same bytes: a space and the text.  Offsets where a token of each ends cut the
text into groups; all A and B tokens of a group are linked.  Links are kept as inverted pair bitmaps:
per id pair and container of ``CONTAINER`` documents, plane k holds the documents in whose number of links
of the pair bit k is set, as a list of positions or, from ``DENSE`` positions on, as a bitmap.

1. ``align`` tokenizes every text once and gives document rows and posting rows;
2. ``merged`` adds up the postings of one pair and container: the planes OR-ed give its documents,
   popcounted, the planes weighed by 2^k its links;
3. ``pair_counts`` sums both per pair, with partial sums per task;
4. ``scores`` sends each pair's count to its postings and these back to their containers, where the
   documents add up what their links count.

A pair that every document holds is a row per container, never a row per document, and rows of one
pair are spread over tasks by container; a group's pairs are taken from its distinct ids.

Defined cases: a text that is null or empty, or whose A or B tokens do not spell the space and the
text, has no tokens; every row is a document of its own, whatever its id; any other columns are
carried along in the struct ``doc``.

Texts are cut before every single space that a letter, a digit or a visible ASCII character follows,
which no token of either vocabulary crosses (A splits words there, ``Vocabularies`` checks B).  What lies
between two cuts is a word here, and no group goes past it, so that documents of about ``UNIT_BYTES``
have their distinct words tokenized and grouped once; a word's pairs are dealt to the documents that
hold it.  Words that are all different are tokenized as one running text, as they stand in a document.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.llm.pieces import read_model

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the public pattern by which byte-level BPE of this family splits words.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CONTAINER_BITS = 13
CONTAINER = 1 << CONTAINER_BITS
DENSE = CONTAINER // 16
CHUNK = 1 << 15
#: Characters of distinct words that are tokenized as one text.
PIECE = 1 << 12
#: Bytes of text aligned at once, pairs made at once, and pairs held before postings are written.
UNIT_BYTES = 2 << 20
PAIRS = 1 << 20
HELD = 3 << 20

#: Characters for which both A encoders are known to split alike, and runs that one of them gives up on.
_HIGH, _BLANK = re.compile("[\u0600-\U0010ffff]"), re.compile(r"\s\s{499}")
#: The space first, so that the pattern is searched for by its one literal character.
_CUT = re.compile(r" (?=[!-~\w])(?<=\S )")
_PLAIN = re.compile(r"[!-~\w]")


def _other(text: str) -> bool:
    return bool(_HIGH.search(text) or _BLANK.search(text))


# -------------------------------------------------------------------------------- vocabularies

def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for
    itself, the other bytes, in order, for the letters from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers and the bytes and written ids of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        entries, letters = json.loads(a), byte_of_letter()
        added = {t["id"]: t["content"] for t in entries.get("added_tokens", [])}
        ids = {i: t for t, i in entries["model"]["vocab"].items() if i not in added}
        self.bytes_a = [b""] * (1 + max([*ids, *added]))
        for i, token in ids.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        self.library = tokenizers.Tokenizer.from_str(a.decode())
        self.library.encode_special_tokens = True
        self.ranks = tiktoken.Encoding("a", pat_str=SPLIT, special_tokens={}, mergeable_ranks={self.bytes_a[i]: i for i in ids})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=b)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.cuts = not any("▁" in t.lstrip("▁") for t in names)
        self.size_a, self.size_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        kinds = ((";", self.bytes_a), (",", self.bytes_a), ("\n", self.bytes_a), ("|", self.bytes_b), (",", self.bytes_b))
        self.written = np.array([sep + str(i) for sep, x in kinds for i in range(len(x))], dtype=object)
        self.kind = np.cumsum([0, *[len(x) for _, x in kinds]])

    def encode_a(self, text: str) -> list[int]:
        if _other(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text that are tokenized as they would be within it."""
        out, at = [], 0
        while self.cuts and len(text) - at > CHUNK:
            cut = _CUT.search(text, at + CHUNK)
            if cut is None:
                break
            out.append(text[at:cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def spelled(self, said: list[str]):
        """(A ids, B ids) of each text, all of which begin with a space; None if they do not spell it."""
        out = []
        for s, pieces in zip(said, self.model.encode([s[1:] for s in said], num_threads=1)):
            ids, raw = self.encode_a(s), s.encode()
            same = b"".join([self.bytes_b[i] for i in pieces]) == raw and b"".join([self.bytes_a[i] for i in ids]) == raw
            out.append((np.array(ids, np.int64), np.array(pieces, np.int64)) if same else None)
        return out

    def encode(self, text: str):
        """[(A ids, B ids)] per chunk of the text; None if the text has no tokens."""
        if not text:
            return None
        parts = self.chunks(text)
        out = self.spelled([" " + parts[0], *parts[1:]])
        return None if any(u is None for u in out) else out

    def words(self, text: str):
        """The words of each chunk of the text, without the spaces that they begin with."""
        for k, part in enumerate(self.chunks(text) if text else []):
            part = part[1:] if k else part
            yield _CUT.split(part) if self.cuts else [part]

    def pieces(self, words: list[str], odd: set[str]) -> list[list[int]]:
        """Positions of the words that are tokenized together: all but the ``odd`` ones, between any two of
        which a text is cut."""
        if not self.cuts:
            return [[k] for k in range(len(words))]
        out = [[k] for k, w in enumerate(words) if w in odd]
        joint = [k for k, w in enumerate(words) if w not in odd]
        kinds = [joint]
        if _other(" ".join(words)):     # A has its own encoder for these
            high = [_other(words[k]) for k in joint]
            kinds = [[k for k, h in zip(joint, high) if h == kind] for kind in (False, True)]
        for at in filter(None, kinds):
            for s, e in _cut_at(np.cumsum([len(words[k]) + 1 for k in at]), PIECE):
                out.append(at[s:e])
        return out

    def encode_words(self, words: list[str], odd: set[str]):
        """Tokens (A ids, B ids) of texts, and of each word in them its position and the byte that it ends at, counted
        from the first text on.  Words that their tokens do not spell are left out."""
        units, order, size, pieces = [], [], [], self.pieces(words, odd)
        while pieces:
            alone = []
            for at, found in zip(pieces, self.spelled([" " + " ".join([words[k] for k in at]) for at in pieces])):
                own = [len(words[k].encode()) + 1 for k in at]
                if found and all(_ends(n[ids], own) for ids, n in zip(found, (self.size_a, self.size_b))):
                    units.append(found)
                    order += at
                    size += own
                elif len(at) > 1:
                    alone += [[k] for k in at]
            pieces = alone
        return units, np.array(order, np.int64), np.cumsum(np.array(size, np.int64))


def _ends(tokens: np.ndarray, words: list[int]) -> bool:
    """Does a token end wherever a word does?  Both are given by their bytes."""
    end, word_end = np.cumsum(tokens), np.cumsum(words)
    return np.array_equal(end[np.searchsorted(end, word_end)], word_end)


@lru_cache(maxsize=2)
def vocabularies(a: bytes, b: bytes) -> Vocabularies:
    return Vocabularies(a, b)


# -------------------------------------------------------------------------------------- groups

class Groups:
    """The groups of several units (texts, chunks or words), whose tokens follow each other."""

    def __init__(self, v: Vocabularies, units, last=None):
        """Units are the given ones, or the words in them that end at the bytes ``last``."""
        self.a, self.b = (np.concatenate([u[k] for u in units]) for k in (0, 1))
        end_a, end_b = np.cumsum(v.size_a[self.a]), np.cumsum(v.size_b[self.b])
        cuts = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a]
        self.of_a, self.of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.n_a, self.n_b = np.bincount(self.of_a, minlength=len(cuts)), np.bincount(self.of_b, minlength=len(cuts))
        if last is None:
            last = end_a[np.cumsum([len(u[0]) for u in units]) - 1]
        self.unit = np.searchsorted(last, cuts)
        self.units = len(last)

    def per_unit(self, values: np.ndarray) -> np.ndarray:
        """Sums per unit of a value per group (units have one group at least)."""
        return np.add.reduceat(values, np.searchsorted(self.unit, np.arange(self.units)))

    def written(self, v: Vocabularies) -> list[str]:
        """``a1,a2|b1;a3|b2`` per unit."""
        n = len(self.a)
        side = np.argsort(np.concatenate([2 * self.of_a, 2 * self.of_b + 1]), kind="stable")
        new_a, new_b = np.ones(n, bool), np.ones(len(self.b), bool)
        new_a[1:] = self.of_a[1:] != self.of_a[:-1]
        new_b[1:] = self.of_b[1:] != self.of_b[:-1]
        kind_a = np.where(new_a, 0, 1)
        kind_a[(np.cumsum(self.n_a) - self.n_a)[np.searchsorted(self.unit, np.arange(self.units))]] = 2
        parts = v.written[np.concatenate([v.kind[kind_a] + self.a, v.kind[np.where(new_b, 3, 4)] + self.b])[side]]
        return "".join(parts.tolist()).split("\n")[1:]

    def pairs(self):
        """Chunks (pair key, unit, links) of the groups' id pairs, each pair of a group once."""
        one = (self.n_a == 1) & (self.n_b == 1)
        first_a, first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        yield _key(self.a[first_a[one]], self.b[first_b[one]]), self.unit[one], np.ones(int(one.sum()), np.int64)
        many_a, many_b = ~one[self.of_a], ~one[self.of_b]
        a, count_a = np.unique(self.of_a[many_a] << 20 | self.a[many_a], return_counts=True)
        b, count_b = np.unique(self.of_b[many_b] << 20 | self.b[many_b], return_counts=True)
        low, high = (np.searchsorted(b >> 20, a >> 20, side=s) for s in ("left", "right"))
        wide = np.cumsum(high - low)
        for s, e in _cut_at(wide, PAIRS):
            size = (high - low)[s:e]
            which = np.repeat(np.arange(s, e), size)
            other = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            yield _key(a[which] & 0xFFFFF, b[other] & 0xFFFFF), self.unit[a[which] >> 20], count_a[which] * count_b[other]


class Words:
    """The distinct words of several documents, numbered as met."""

    def __init__(self, v: Vocabularies):
        self.v, self.number, self.odd, self.said = v, defaultdict(count().__next__), set(), []

    def add(self, text: str) -> None:
        """Take in a document, kept as the numbers of its words, chunk by chunk."""
        said = []
        for words in self.v.words(text):
            said.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            # Only the ends of a document can be such that other words cannot stand beside them.
            if not _PLAIN.match(words[0]):
                self.odd.add(words[0])
            if words[-1][-1:].isspace():
                self.odd.add(words[-1])
        self.said.append(said)


class Held:
    """The groups of the documents of ``words``; those with a word that its tokens do not spell have none."""

    def __init__(self, words: Words):
        units, order, last = words.v.encode_words(list(words.number), words.odd)
        at = np.full(len(words.number), -1)
        at[order] = np.arange(len(order))
        self.v, self.docs = words.v, len(words.said)
        size = np.array([sum(map(len, parts)) for parts in words.said], np.int64)
        word = at[np.concatenate([np.zeros(0, np.int32), *[w for parts in words.said for w in parts]])]
        doc = np.repeat(np.arange(self.docs), size)
        lost = np.zeros(self.docs, bool)
        lost[doc[word < 0]] = True
        size[lost] = 0
        self.word = word[~lost[doc]]
        self.edge = np.concatenate([[0], np.cumsum(size)])
        self.groups = Groups(self.v, units, last) if units else None

    def numbers(self) -> np.ndarray:
        """``NUMBERS`` of each document."""
        out, g = np.zeros((self.docs, 4), np.int64), self.groups
        if g:
            for k, values in enumerate((g.n_a, g.n_b, np.ones_like(g.n_a), g.n_a * g.n_b)):
                total = np.concatenate([[0], np.cumsum(g.per_unit(values)[self.word])])
                out[:, k] = total[self.edge[1:]] - total[self.edge[:-1]]
        return out

    def written(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        written = self.groups.written(self.v) if self.groups else []
        return [";".join([written[w] for w in self.word[s:e].tolist()]) for s, e in zip(self.edge[:-1], self.edge[1:])]

    def pairs(self):
        """Chunks (pair key, document, links): those of a word go to every document that holds it, as often as it does."""
        if not self.groups:
            return
        doc = np.repeat(np.arange(self.docs), np.diff(self.edge))
        at, times = np.unique(self.word * self.docs + doc, return_counts=True)
        doc, first = at % self.docs, np.searchsorted(at, np.arange(self.groups.units + 1) * self.docs)
        for key, word, links in self.groups.pairs():
            size = first[word + 1] - first[word]
            for s, e in _cut_at(np.cumsum(size), PAIRS):
                n = size[s:e]
                which = np.repeat(np.arange(s, e), n)
                holder = first[word[which]] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                yield key[which], doc[holder], links[which] * times[holder]


def _key(a, b):
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _cut_at(total: np.ndarray, limit: int):
    """Ranges of a running total of about ``limit`` each."""
    s = 0
    while s < len(total):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + limit, side="right")))
        yield s, e
        s = e


def summed(key, pos, m):
    """Distinct (key, pos) in order, with their sums."""
    if len(key) and int(key.max()) < 1 << 62 - CONTAINER_BITS and int(pos.max()) < CONTAINER:
        both = key << CONTAINER_BITS | pos
        order = np.argsort(both)
        both, m = both[order], m[order]
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        both = both[at]
        return both >> CONTAINER_BITS, both & CONTAINER - 1, np.add.reduceat(m, at)
    order = np.lexsort((pos, key))
    key, pos, m = key[order], pos[order], m[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    at = np.flatnonzero(new)
    return key[at], pos[at], np.add.reduceat(m, at) if len(at) else m


# ------------------------------------------------------------------------------------- bitmaps

PLANES = pa.list_(pa.binary())


def encode_planes(row: np.ndarray, pos: np.ndarray, m: np.ndarray, rows: int) -> pa.Array:
    """Planes per row (0 .. rows-1, each with an entry) of the links ``m`` at ``pos``, sorted by both."""
    first = np.searchsorted(row, np.arange(rows))
    planes = np.frexp(np.maximum.reduceat(m, first))[1] if rows else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(planes)])
    found = []
    for k in range(int(planes.max()) if rows else 0):
        at = np.flatnonzero(m >> k & 1)
        found.append((start[row[at]] + k, pos[at]))
    slot, p = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    order = np.lexsort((p, slot))
    slot, p = slot[order], p[order]
    n = np.bincount(slot, minlength=start[-1])
    dense = n >= DENSE
    edge = np.concatenate([[0], np.cumsum(np.where(dense, CONTAINER // 8, 2 * n))])
    out = np.zeros(edge[-1], dtype=np.uint8)
    listed = ~dense[slot]
    rank = np.arange(len(slot)) - (np.cumsum(n) - n)[slot]
    out.view("<u2")[edge[slot[listed]] // 2 + rank[listed]] = p[listed]
    np.bitwise_or.at(out, edge[slot[~listed]] + (p[~listed] >> 3), (1 << (p[~listed] & 7)).astype(np.uint8))
    values = pa.Array.from_buffers(pa.binary(), int(start[-1]), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(out)])
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), values)


def decode_planes(planes: pa.Array):
    """(row, position, 2^plane) of all bits."""
    values, held = planes.flatten(), planes.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(held)), held)
    weight = np.int64(1) << (np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held))
    edge = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edge[0]:edge[-1]].copy() if raw is not None else np.zeros(0, np.uint8)
    size = np.diff(edge)
    dense = size == CONTAINER // 8
    listed = np.repeat(~dense, size // 2)
    slot, pos = np.repeat(np.flatnonzero(~dense), size[~dense] // 2), data.view("<u2")[listed].astype(np.int64)
    if dense.any():
        bits = np.unpackbits(data[np.repeat(dense, size)].reshape(-1, CONTAINER // 8), axis=1, bitorder="little")
        r, p = np.nonzero(bits)
        slot, pos = np.concatenate([slot, np.flatnonzero(dense)[r]]), np.concatenate([pos, p])
    return row[slot], pos, weight[slot]


# ------------------------------------------------------------------------------------ operator

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


class Postings:
    """Links of a container's documents, held until they are many."""

    def __init__(self):
        self.container, self.held, self.size = None, [], 0

    def add(self, key, pos, m) -> None:
        self.held.append(summed(key, pos, m))
        self.size += len(self.held[-1][0])

    def rows(self):
        """(a, b, container, planes) arrays of what is held."""
        key, pos, m = summed(*(np.concatenate([h[i] for h in self.held]) for i in range(3)))
        pair, row = np.unique(key, return_inverse=True)
        self.held, self.size = [], 0
        for s, e in _cut_at(np.arange(1, len(pair) + 1), 1 << 15):
            a, b = np.searchsorted(row, [s, e])
            yield (pair[s:e] >> 32, pair[s:e] & 0xFFFFFFFF, np.full(e - s, self.container),
                   encode_planes(row[a:b] - s, pos[a:b], m[a:b], e - s))


def align(docs: DataFrame, columns: list[str], vocabulary: str = VOCABULARY_A, model: str = MODEL_B) -> DataFrame:
    """Document rows (doc, rec, n_a, n_b, n_groups, n_links, groups) and posting rows (a, b, container,
    planes), told apart by ``rec is null``.  ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``."""
    files = [read_model(docs.sparkSession, p) for p in (vocabulary, model)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), "text")
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("rec", T.LongType()), *[T.StructField(c, T.LongType()) for c in NUMBERS],
                           T.StructField("groups", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
                           T.StructField("container", T.LongType()), T.StructField("planes", T.ArrayType(T.BinaryType()))])

    def run(batches):
        v = vocabularies(*files)
        kinds = [pa.int64()] * 5 + [pa.string()]
        rec, postings, doc_type = TaskContext.get().partitionId() << 33, Postings(), None

        def flush():
            if postings.size:
                for a, b, container, planes in postings.rows():
                    n = len(a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, doc_type), *[pa.nulls(n, k) for k in kinds], pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                         pa.array(container), planes], names=schema.names)

        def document_rows(docs_of, recs, numbers, texts):
            n = len(recs)
            return pa.RecordBatch.from_arrays(
                [docs_of, pa.array(recs, pa.int64()), *[pa.array(numbers[:, k]) for k in range(4)], pa.array(texts, pa.string()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, PLANES)], names=schema.names)

        for batch in batches:
            doc_type, at = batch.column("doc").type, 0
            while at < batch.num_rows:
                # Documents of one container and about UNIT_BYTES are aligned together.
                words, size, n = Words(v), 0, 0
                container = rec >> CONTAINER_BITS
                if container != postings.container:
                    yield from flush()
                    postings.container = container
                while at + n < batch.num_rows and size < UNIT_BYTES and (rec + n) >> CONTAINER_BITS == container:
                    text = batch.column("text")[at + n].as_py()
                    words.add(text)
                    size += len(text or "")
                    n += 1
                held = Held(words)
                numbers, texts = held.numbers(), held.written()
                for key, doc, m in held.pairs():
                    postings.add(key, (rec + doc) % CONTAINER, m)
                    if postings.size >= HELD:
                        yield from flush()
                yield document_rows(batch.column("doc").slice(at, n), np.arange(rec, rec + n), numbers, texts)
                at, rec = at + n, rec + n
        yield from flush()

    return rows.mapInArrow(run, schema)


def _in_tables(batches, rows: int = 1 << 13):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def merged(postings: DataFrame) -> DataFrame:
    """One row per pair and container: its planes, documents (``n_docs``) and links (``n_links``)."""
    schema = "a int, b int, container long, planes array<binary>, n_docs long, n_links long"
    names = ["a", "b", "container", "planes", "n_docs", "n_links"]

    def close(table):
        keys = [table.column(c).to_numpy() for c in names[:3]]
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        line = np.cumsum(new) - 1
        row, pos, weight = decode_planes(table.column("planes").chunk(0))
        row, pos, m = summed(line[row], pos, weight)
        n = int(line[-1]) + 1
        planes = encode_planes(row, pos, m, n)
        links = np.add.reduceat(m, np.searchsorted(row, np.arange(n)))
        return pa.RecordBatch.from_arrays([*[pa.array(k[new]) for k in keys], planes, pa.array(np.bincount(row, minlength=n)), pa.array(links)],
                                          names=names)

    def run(batches):
        rest = None
        for table in _in_tables(batches):
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            keys = [table.column(c).to_numpy() for c in names[:3]]
            same = np.logical_and.reduce([k == k[-1] for k in keys])       # the last key may go on
            edge = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if edge:
                yield close(pa.table(table.slice(0, edge)).combine_chunks())
            rest = table.slice(edge)
        if rest is not None and rest.num_rows:
            yield close(rest.combine_chunks())

    rows = postings.select("a", "b", "container", "planes")
    return rows.repartition("a", "b", "container").sortWithinPartitions("a", "b", "container").mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links) of each linked pair over the whole corpus."""
    return postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(rec, count_sum, n_best): the documents' links weighed by their pair's documents, and those
    whose pair is the most common of its A id."""
    top = counts.groupBy(F.col("a").alias("top_a")).agg(F.max("n_docs").alias("top"))
    rated = counts.join(top, F.col("a") == F.col("top_a")).select(
        F.col("a").alias("of_a"), F.col("b").alias("of_b"), F.col("n_docs").alias("count"), (F.col("n_docs") == F.col("top")).alias("best"))
    sent = postings.select("a", "b", "container", "planes").join(rated, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for table in _in_tables(batches):
            row, pos, weight = decode_planes(table.column("planes").chunk(0))
            container = table.column("container").to_numpy()
            count, best = table.column("count").to_numpy(), table.column("best").to_numpy()
            for c in np.unique(container).tolist():
                total = sums.setdefault(c, np.zeros((3, CONTAINER), dtype=np.int64))
                mine = container[row] == c
                r, p, w = row[mine], pos[mine], weight[mine]
                np.add.at(total[0], p, w * count[r])
                np.add.at(total[1], p, w * best[r])
                total[2][p] = 1
        for c, (total, best, seen) in sums.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array((c << CONTAINER_BITS) + at), pa.array(total[at]), pa.array(best[at])],
                                             names=["rec", "count_sum", "n_best"])

    dealt = sent.select("container", "planes", "count", "best").repartition("container")
    return dealt.mapInArrow(run, "rec long, count_sum long, n_best long")
