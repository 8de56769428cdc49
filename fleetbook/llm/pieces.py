"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model is a byte-pair vocabulary with byte fallback.  A sequence of pieces is the encoding of
a text exactly if every two neighbours are the encoding of their own concatenation, so encoding
is a path problem: positions are states, pieces are steps, and a step that its neighbour does not
allow weighs minus infinity.  A text longer than ``CHUNK`` characters is split into chunks.  Where
a cut falls between a character and a space no piece can cross it and the chunk stands alone;
inside a run of text without spaces the pieces that may cross a cut are its boundary states.
Every such chunk yields a transfer matrix from the states of its left cut to those of its right
cut (best sum of piece scores, or minus infinity); the matrices of a document are combined by the
associative max-plus product, and with the states of its cuts known every chunk is traced back by
itself.  The result is that of the sentencepiece library on the whole text.

Defined cases: null text is empty and has one chunk without pieces; a literal U+2581 is a space,
as in the library; characters outside the vocabulary become byte pieces; repeated rows are
documents of their own (``rec_id``); extra columns are ignored.  The model file's path is a
parameter; the file is read on the driver and travels to the tasks (half a megabyte).
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.llm.common import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32768
#: How far before its target a cut may move back to a space.
REACH = 1024
SPACE = "▁"
NONE = float("-inf")


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes: from the driver's disk, or through Spark if ``path`` is a URL."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """The library's model, and its pieces and scores for the steps across cuts."""

    def __init__(self, model: bytes):
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.lib
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size())
                      if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.longest = max(map(len, self.score))
        self.allowed = lru_cache(maxsize=1 << 18)(self._allowed)

    def merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best scored neighbours first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], NONE)
                if s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _allowed(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def steps(self, text: str, at: int):
        """Pieces that start at ``at``: those of the vocabulary, and any single character."""
        for size in range(1, min(self.longest, len(text) - at) + 1):
            piece = text[at:at + size]
            if size == 1 or piece in self.score:
                yield piece

    def ids(self, piece: str) -> list[int]:
        """Ids of one piece; a character outside the vocabulary is its bytes."""
        if piece in self.score:
            return [self.lib.piece_to_id(piece)]
        return [self.lib.piece_to_id(f"<0x{b:02X}>") for b in piece.encode("utf-8")]

    def crossing(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Boundary states of a cut: pieces (start, end) with start < cut <= end."""
        return [(s, s + len(p)) for s in range(max(0, cut - self.longest), cut) for p in self.steps(text, s) if s + len(p) >= cut]


def cut_points(text: str, chunk: int = CHUNK, reach: int = REACH) -> list[tuple[int, bool]]:
    """Cuts (position, alone) of a text in which spaces are ``SPACE``; the first is 0, the last the
    length.  ``alone``: a space after another character follows, which no piece crosses."""
    cuts, at = [(0, True)], chunk
    while at < len(text):
        cut = at
        while cut > cuts[-1][0] and text[cut] == SPACE:           # never inside a run of spaces
            cut -= 1
        if text[cut] != SPACE and cut < at:
            cut += 1
        if not (text[cut] == SPACE and text[cut - 1] != SPACE):
            back = text.rfind(SPACE, max(cuts[-1][0] + 1, cut - reach), cut)
            while back > cuts[-1][0] + 1 and text[back - 1] == SPACE:
                back -= 1
            cut = back if back > cuts[-1][0] and text[back - 1] != SPACE else cut
        if cut <= cuts[-1][0] or text[cut] == SPACE and text[cut - 1] == SPACE:   # a run of spaces as long as a chunk
            at += chunk
            continue
        cuts.append((cut, text[cut] == SPACE))
        at = cut + chunk
    return [*cuts, (len(text), True)]


CHUNKS = ("rec_id long, doc_id long, chunk_no int, n_chunks int, left_alone boolean, right_alone boolean, "
          "before int, body int, text string")


def split_documents(docs: DataFrame, chunk: int = CHUNK, reach: int = REACH, margin: int = 16) -> DataFrame:
    """Chunk rows; ``text`` is the chunk with ``margin`` characters around it where a cut is not
    alone, of which ``before`` stand before the chunk's ``body`` characters."""
    src = docs.select(F.monotonically_increasing_id().alias("rec_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for rec, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "doc_id", "text"))):
                text = (SPACE + raw.replace(" ", SPACE)) if raw else ""
                if len(text) <= chunk:
                    out.append((rec, doc, 0, 1, True, True, 0, len(text), text))
                    size += len(text)
                else:
                    cuts = cut_points(text, chunk, reach)
                    for n, ((a, left), (b, right)) in enumerate(zip(cuts, cuts[1:])):
                        before = 0 if left else min(margin, a)
                        after = 0 if right else margin
                        out.append((rec, doc, n, len(cuts) - 1, left, right, before, b - a, text[a - before:b + after]))
                        size += b - a
                if size > 4 << 20:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    def table(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return src.mapInArrow(run, CHUNKS)


# ------------------------------------------------------------------------- transfer matrices

def entries(vocabulary: Vocabulary, text: str, before: int, alone: bool) -> list[tuple[int, int]]:
    """States of a chunk's left cut, in positions relative to the cut."""
    if alone:
        return [(0, 0)]
    return [(s - before, e - before) for s, e in vocabulary.crossing(text, before)]


def paths_from(vocabulary: Vocabulary, text: str, origin: int, state: tuple[int, int], end: int) -> dict:
    """Best way to every position of the chunk after ``state``: {position: (score, start of the
    last piece, score before it)}; positions are relative to the cut at ``origin``."""
    start, at = state
    ways = {at: (0.0, start)}
    for p in range(at, end):
        way = ways.get(p)
        if way is None:
            continue
        last = text[origin + way[1]:origin + p]
        for piece in vocabulary.steps(text, origin + p):
            if not last or vocabulary.allowed(last, piece):
                score = way[0] + vocabulary.score.get(piece, 0.0)
                q = p + len(piece)
                if q not in ways or score > ways[q][0]:
                    ways[q] = (score, p)
    return ways


def exit_states(vocabulary: Vocabulary, text: str, origin: int, body: int, alone: bool, ways: dict) -> dict:
    """{state: score} of the right cut, positions relative to that cut."""
    if alone:
        return {(0, 0): ways[body][0]} if body in ways else {}
    out = {}
    for s, e in vocabulary.crossing(text, origin + body):
        s, e = s - origin, e - origin
        if e in ways and ways[e][1] == s:
            out[s - body, e - body] = ways[e][0]
    return out


def transfer(vocabulary: Vocabulary, text: str, before: int, body: int, left: bool, right: bool) -> dict:
    """{(entry state, exit state): score} of a chunk; missing pairs weigh minus infinity."""
    out = {}
    for state in entries(vocabulary, text, before, left):
        ways = paths_from(vocabulary, text, before, state, body)
        for to, score in exit_states(vocabulary, text, before, body, right, ways).items():
            out[state, to] = score
    return out


def max_plus(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    rows: dict = {}
    for (mid, to), score in b.items():
        rows.setdefault(mid, []).append((to, score))
    out: dict = {}
    for (start, mid), score in a.items():
        for to, more in rows.get(mid, ()):
            if score + more > out.get((start, to), NONE):
                out[start, to] = score + more
    return out


def scan(matrices: list[dict]) -> list[dict]:
    """All products matrices[0] .. matrices[i], by halving: pairs are combined first."""
    if len(matrices) <= 1:
        return matrices
    pairs = scan([max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else max_plus(pairs[i // 2 - 1], matrices[i]))
    return out


def cut_states(matrices: list[dict]) -> list[tuple[int, int]]:
    """The state of every cut on the best path through all chunks (first and last included)."""
    upto = scan(matrices)
    state = (0, 0)
    states = [state]
    for i in range(len(matrices) - 1, -1, -1):
        if i == 0:
            state = (0, 0)
        else:     # the state before chunk i from which the best path reaches ``state``
            options = [(upto[i - 1][(0, 0), s] + score, s) for (s, to), score in matrices[i].items()
                       if to == state and ((0, 0), s) in upto[i - 1]]
            state = max(options)[1]
        states.append(state)
    return states[::-1]


STATES = "rec_id long, chunk_no int, entry_start int, entry_end int, exit_start int, exit_end int"
MATRIX = ("rec_id long, chunk_no int, cells array<struct<a:int, b:int, c:int, d:int, score:double>>")


def boundary_states(chunks: DataFrame, model: bytes) -> DataFrame:
    """States at the cuts of chunks that have a cut which is not alone."""
    def matrices(frames):
        vocabulary = Vocabulary(model)
        for pdf in frames:
            rows = [(r.rec_id, r.chunk_no, [{"a": s[0], "b": s[1], "c": t[0], "d": t[1], "score": score} for (s, t), score in
                                            transfer(vocabulary, r.text, r.before, r.body, r.left_alone, r.right_alone).items()])
                    for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["rec_id", "chunk_no", "cells"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_no")
        found = [{((c["a"], c["b"]), (c["c"], c["d"])): c["score"] for c in cells} for cells in pdf["cells"]]
        numbers, out, run = pdf["chunk_no"].tolist(), [], []
        for i, n in enumerate(numbers):       # stretches of chunks between cuts that are alone
            run.append(i)
            if all(to == (0, 0) for _, to in found[i]):
                states = cut_states([found[k] for k in run])
                out += [(numbers[k], *states[j], *states[j + 1]) for j, k in enumerate(run)]
                run = []
        result = pd.DataFrame(out, columns=["chunk_no", "entry_start", "entry_end", "exit_start", "exit_end"])
        result.insert(0, "rec_id", pdf["rec_id"].iloc[0])
        return result

    joined = chunks.filter("not (left_alone and right_alone)")
    cells = stored(joined.select("rec_id", "chunk_no", "text", "before", "body", "left_alone", "right_alone")
                   .mapInPandas(matrices, MATRIX), "piece-matrices")
    return stored(cells.groupBy("rec_id").applyInPandas(solve, STATES), "piece-states")


def trace(vocabulary: Vocabulary, text: str, before: int, body: int, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
    """Ids of the pieces that start in a chunk, given the states of its cuts."""
    ways = paths_from(vocabulary, text, before, entry, body)
    end, start = body + leave[1], body + leave[0]
    pieces = []
    while end > entry[1]:
        pieces.append(text[before + start:before + end])
        end = start
        if end <= entry[1]:
            break
        start = ways[end][1]
    return [i for p in reversed(pieces) for i in vocabulary.ids(p)]


ENCODED = "rec_id long, doc_id long, chunk_no int, n_chunks int, n_pieces int, ids array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK, reach: int = REACH) -> DataFrame:
    """Chunk rows ENCODED: put together by chunk_no, ``ids`` are the encoding of the whole text.

    ``round_trip``: the chunk's pieces decode to its text (chunks whose cuts are not alone decode
    to the text between the outer ends of their pieces).
    """
    model = read_model(docs.sparkSession, model_path)
    chunks = stored(split_documents(docs, chunk, reach), "piece-chunks")
    states = boundary_states(chunks, model)
    at = states.select(F.col("rec_id").alias("r2"), F.col("chunk_no").alias("c2"), "entry_start", "entry_end", "exit_start", "exit_end")
    cut = chunks.filter("not (left_alone and right_alone)") \
        .join(at, (F.col("rec_id") == F.col("r2")) & (F.col("chunk_no") == F.col("c2"))).drop("r2", "c2")
    whole = chunks.filter("left_alone and right_alone")
    for c in ("entry_start", "entry_end", "exit_start", "exit_end"):
        whole = whole.withColumn(c, F.lit(0))

    def run(batches):
        vocabulary = Vocabulary(model)
        for batch in batches:
            rows = batch.to_pylist()
            alone = [r for r in rows if r["left_alone"] and r["right_alone"]]
            # a chunk that begins with a space: the library puts that space before its text itself
            spoken = [r["text"][1:].replace(SPACE, " ") for r in alone]
            ids = vocabulary.lib.encode(spoken, num_threads=1)
            for r, got, said in zip(alone, ids, vocabulary.lib.decode(ids) if ids else []):
                if not got and r["text"]:                   # nothing but the first space
                    got = vocabulary.ids(SPACE)
                r["ids"], r["ok"] = got, said == r["text"][1:].replace(SPACE, " ")
            for r in rows:
                if "ids" not in r:
                    r["ids"] = trace(vocabulary, r["text"], r["before"], r["body"], (r["entry_start"], r["entry_end"]),
                                     (r["exit_start"], r["exit_end"]))
                    a, b = r["before"] + r["entry_end"], r["before"] + r["body"] + r["exit_end"]
                    r["ok"] = decode_ids(vocabulary, r["ids"]) == r["text"][a:b].replace(SPACE, " ")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["rec_id"] for r in rows], pa.int64()), pa.array([r["doc_id"] for r in rows], pa.int64()),
                 pa.array([r["chunk_no"] for r in rows], pa.int32()), pa.array([r["n_chunks"] for r in rows], pa.int32()),
                 pa.array([len(r["ids"]) for r in rows], pa.int32()), pa.array([r["ids"] for r in rows], pa.list_(pa.int32())),
                 pa.array([r["ok"] for r in rows], pa.bool_())], names=[x.split()[0] for x in ENCODED.split(", ") if " " in x])

    return whole.unionByName(cut).mapInArrow(run, ENCODED)


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of pieces, first space kept."""
    raw = b"".join(bytes([int(p[3:5], 16)]) if vocabulary.lib.is_byte(i) else p.encode("utf-8")
                   for i, p in ((i, vocabulary.lib.id_to_piece(i)) for i in ids))
    return raw.decode("utf-8", errors="replace").replace(SPACE, " ")
