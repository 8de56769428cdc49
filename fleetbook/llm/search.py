"""Ranked lexical search for many queries at once, sharing what the queries have in common.

A query (*item*) is a bag of terms; a document's score is the sum of what each term of the item, with
its repeats, adds for it.  Sums of integers may be taken in any order, so sums that several items
need are taken once per document:

1. items are dealt into blocks of at most ``BLOCK_TERMS`` (item, term) rows, the bound of everything
   that travels to the tasks;
2. ``mine`` finds shared term sets among the items of a block: terms that the same items hold, equally
   often, are one *class*; then, round by round, two nodes that stand next to each other in the
   lists of two items or more become a node of their own.  The result is a DAG whose leaves are
   classes and whose roots are items;
3. ``extract`` reads every text once per block and keeps the frequencies of the block's terms;
4. ``rank`` materialises, for some documents at a time, the accumulator of every node once (classes
   from the frequencies, then level by level), sums each item's nodes, and keeps each item's best
   documents per task; the best of all tasks are ranked at the end.

Defined cases: a null text has no terms, and an item or document without terms has no results; rows
that repeat an id are items, or documents, of their own; equal scores are in order of doc_id, a null
id last; long texts are read in segments of ``SEGMENT`` bytes; other columns are ignored.  Terms are
found by 64-bit hashes and confirmed on their bytes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetbook.llm.common import LOWER, ascii_lower, batch_bytes, prefix_hash, span_hash, stored, tokens

#: Fixed value: what a term is made of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[[b for b in range(128) if not chr(b).isalnum()]] = True

BLOCK_TERMS = 200_000
SEGMENT = 1 << 20
#: Bytes of the accumulators held at once.
HELD_BYTES = 64 << 20
TOP = 20


# -------------------------------------------------------------------------------------- queries

def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, q): how often each item holds each term; ``item`` numbers the rows."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), ascii_lower(F.col("text")).alias("said"))
    found = rows.select("item", "item_id", F.explode(F.regexp_extract_all("said", F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("item", "item_id", "term").agg(F.count("*").alias("q"))


def in_blocks(terms: DataFrame, size: int) -> DataFrame:
    """``terms`` with the block of their item: items in order, ``size`` rows a block at most, or one item."""
    sizes = terms.groupBy("item").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    dealt = sizes.select(F.col("item").alias("of"), F.floor((upto - 1) / size).cast("long").alias("block"))
    return terms.join(dealt, F.col("item") == F.col("of")).drop("of")


class Plan:
    """The shared sums of a block of items.

    ``terms``: its terms' bytes by ascending hash.  Leaves are distinct (term, repeats) of items;
    ``leaf_class`` tells their class.  Nodes are the classes and then, ``levels`` by levels, sums of two
    earlier nodes.  Item ``items[i]`` is the sum of the nodes ``of_item[edge[i]:edge[i+1]]``.
    """

    def __init__(self, item: np.ndarray, term: list[str], q: np.ndarray):
        said, term_no = np.unique(np.array([t.encode() for t in term], dtype=object), return_inverse=True)
        data = np.frombuffer(b"".join(said), np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(s) for s in said])])
        hashes = span_hash(prefix_hash(data), edge[:-1], edge[1:])
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes, self.terms = hashes[order], [said[i] for i in order]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two terms of a block share a 64-bit hash")
        self.items, item_no = np.unique(item, return_inverse=True)
        leaf, leaf_no = np.unique(np.stack([place[term_no], q]), axis=1, return_inverse=True)
        self.leaf_term, self.leaf_q = leaf
        self._classes(item_no, leaf_no.reshape(-1))
        self._share(item_no, leaf_no.reshape(-1))

    @classmethod
    def read(cls, arrays: bytes) -> Plan:
        plan = cls.__new__(cls)
        vars(plan).update(pickle.loads(arrays))
        return plan

    def _classes(self, item_no, leaf_no):
        """Leaves that exactly the same items hold are one class."""
        order = np.lexsort((item_no, leaf_no))
        holders = np.split(item_no[order], np.searchsorted(leaf_no[order], np.arange(1, len(self.leaf_term))))
        seen: dict[bytes, int] = {}
        self.leaf_class = np.array([seen.setdefault(h.tobytes(), len(seen)) for h in holders], np.int64)
        self.classes = len(seen)

    def _share(self, item_no, leaf_no):
        """Rounds of joining neighbours that two lists or more hold; lists run from common to rare."""
        node_item = np.unique(np.stack([item_no, self.leaf_class[leaf_no]]), axis=1)
        common = np.bincount(node_item[1], minlength=self.classes)
        order = np.lexsort((node_item[1], -common[node_item[1]], node_item[0]))
        owner, node = node_item[0][order], node_item[1][order]
        self.left, self.right, self.levels, n = [], [], [], self.classes
        while True:
            beside = owner[1:] == owner[:-1]
            pair = node[:-1][beside] << 32 | node[1:][beside]
            pairs, count = np.unique(pair, return_counts=True)
            pairs = pairs[np.argsort(-count, kind="stable")][:int((count > 1).sum())]
            used, chosen = np.zeros(n, dtype=bool), []
            for p in pairs.tolist():
                x, y = p >> 32, p & 0xFFFFFFFF
                if not used[x] and not used[y]:
                    used[x] = used[y] = True
                    chosen.append(p)
            if not chosen:
                break
            chosen = np.sort(np.array(chosen, np.int64))
            self.left.append(chosen >> 32)
            self.right.append(chosen & 0xFFFFFFFF)
            at = np.flatnonzero(beside)
            new = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
            hit = chosen[new] == pair
            node[at[hit]] = n + new[hit]
            keep = np.ones(len(node), dtype=bool)
            keep[at[hit] + 1] = False
            owner, node = owner[keep], node[keep]
            n += len(chosen)
            self.levels.append(n)
        self.nodes, self.of_item = n, node
        self.edge = np.searchsorted(owner, np.arange(len(self.items)))

    def additions(self) -> int:
        """Sums taken per document for all items."""
        return len(self.leaf_term) + sum(map(len, self.left)) + len(self.of_item)

    def totals(self, leaf: np.ndarray, at: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """(items, docs) sums, from values of leaves for documents."""
        held = np.zeros((self.nodes, docs), dtype=np.int64)
        np.add.at(held, (self.leaf_class[leaf], at), value)
        begin = self.classes
        for left, right, end in zip(self.left, self.right, self.levels):
            held[begin:end] = held[left] + held[right]
            begin = end
        return np.add.reduceat(held[self.of_item], self.edge, axis=0)


def mine(terms: DataFrame) -> DataFrame:
    """(block, plan): the arrays of the ``Plan`` of every block."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        plan = Plan(group["item"].to_numpy(), group["term"].tolist(), group["q"].to_numpy())
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "plan": [pickle.dumps(vars(plan))]})

    return terms.groupBy("block").applyInPandas(run, "block long, plan binary")


# ------------------------------------------------------------------------------------ documents

def segments(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about ``SEGMENT`` bytes that end after a gap or a text."""
    a = 0
    while a < len(data):
        b = min(a + SEGMENT, len(data))
        text_end = int(offsets[np.searchsorted(offsets, b)])
        while b < text_end:
            gap = np.flatnonzero(IS_GAP[data[b:min(b + 65536, text_end)]])
            if len(gap):
                b += int(gap[0]) + 1
                break
            b = min(b + 65536, text_end)
        yield a, b
        a = b


class Vocabulary:
    """The terms to look for."""

    def __init__(self, plan: Plan):
        self.hashes = plan.hashes
        self.data = np.frombuffer(b"".join(plan.terms), np.uint8)
        self.edge = np.concatenate([[0], np.cumsum([len(t) for t in plan.terms])])

    def find(self, data, start, end):
        """(which, term): tokens that are terms, equal in their bytes."""
        code = span_hash(prefix_hash(data), start, end)
        term = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
        which = np.flatnonzero((self.hashes[term] == code) & (self.edge[term + 1] - self.edge[term] == end - start))
        term, size = term[which], (end - start)[which]
        begin = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(begin, size)
        same = data[np.repeat(start[which], size) + step] == self.data[np.repeat(self.edge[term], size) + step]
        good = np.logical_and.reduceat(same, begin) if len(which) else np.zeros(0, bool)
        return which[good], term[good]


FREQUENCIES = "doc_ids array<long>, n array<long>, held array<int>, term array<int>, tf array<long>"


def extract(docs: DataFrame, plan: Plan) -> DataFrame:
    """Per batch of documents: ids, numbers of terms, and the frequencies of the plan's terms
    (``held`` entries per document)."""
    vocabulary = Vocabulary(plan)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            data, offsets = batch_bytes(batch.column("text"))
            docs_here, terms = batch.num_rows, len(vocabulary.hashes)
            n, keys, counts = np.zeros(docs_here, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in segments(data, offsets):
                part = LOWER[data[a:b]]
                doc, start, end = tokens(part, np.clip(offsets, a, b) - a, IS_GAP)
                n += np.bincount(doc, minlength=docs_here)
                which, term = vocabulary.find(part, start, end)
                key, count = np.unique(doc[which] * terms + term, return_counts=True)
                keys.append(key)
                counts.append(count)
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.zeros(len(key), np.int64)
            np.add.at(tf, inverse, np.concatenate(counts))
            held = np.bincount(key // terms, minlength=docs_here)

            def one(values, kind):
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))

            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([one(ids, None), one(n, pa.int64()), one(held, pa.int32()), one(key % terms, pa.int32()),
                                              one(tf, pa.int64())], names=["doc_ids", "n", "held", "term", "tf"])

    return src.mapInArrow(run, FREQUENCIES)


class Statistics:
    """Corpus counts: documents with a term, all their terms, documents per term of a plan."""

    def __init__(self, frequencies: DataFrame, terms: int):
        n = frequencies.select(F.explode("n").alias("n")).filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.documents, self.length = map(int, n)
        self.df = np.zeros(terms, np.int64)
        for row in frequencies.select(F.explode("term").alias("term")).groupBy("term").count().collect():   # the block's terms
            self.df[row["term"]] = row["count"]

    def weights(self) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.documents + 2) / (2 * self.df + 1))).astype(np.int64)

    def damping(self, n: np.ndarray) -> np.ndarray:
        """``m`` of documents of ``n`` terms."""
        if len(n) and 25 * int(n.max()) * self.documents >= 1 << 62:
            n = n.astype(object)                                    # beyond 64 bits on the way
        return (100 - 25 + (25 * n * self.documents) // max(1, self.length)).astype(np.int64)


class Best:
    """The ``top`` best documents of every item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.held, self.size = [np.zeros((4, 0), np.int64)], 0

    def add(self, totals: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        item, at = np.nonzero(totals >= self.floor[:, None])
        self.held.append(np.stack([item, totals[item, at], null[at], doc[at]]))
        self.size += len(item)
        if self.size > 4 * self.top * len(self.floor):
            self.settle()

    def settle(self) -> np.ndarray:
        item, score, null, doc = np.concatenate(self.held, axis=1)
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        best = np.stack([item, score[order], null[order], doc[order]])[:, rank < self.top]
        last = rank[rank < self.top] == self.top - 1
        self.floor[best[0][last]] = best[1][last]
        self.held, self.size = [best], 0
        return best


def rank(frequencies: DataFrame, plan: Plan, statistics: Statistics, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item."""
    weight = statistics.weights()
    leaf_order = np.argsort(plan.leaf_term, kind="stable")
    leaf_edge = np.searchsorted(plan.leaf_term[leaf_order], np.arange(len(plan.terms) + 1))
    step = max(1, HELD_BYTES // 8 // (plan.nodes + len(plan.of_item)))

    def run(batches):
        best = Best(len(plan.items), top)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, held, term, tf = (batch.column(c)[i].values for c in ("doc_ids", "n", "held", "term", "tf"))
                null, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                n, held, term, tf = (x.to_numpy() for x in (n, held, term, tf))
                at = np.repeat(np.arange(len(n)), held)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * statistics.damping(n)[at]))
                size = leaf_edge[term + 1] - leaf_edge[term]         # a term is a leaf for each number of repeats
                which = np.repeat(np.arange(len(term)), size)
                leaf = leaf_order[leaf_edge[term][which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)]
                value, at = value[which] * plan.leaf_q[leaf], at[which]
                for s in range(0, len(n), step):
                    e = min(s + step, len(n))
                    a, b = np.searchsorted(at, [s, e])
                    if a < b:
                        best.add(plan.totals(leaf[a:b], at[a:b] - s, value[a:b], e - s), null[s:e].astype(np.int64), doc[s:e])
        item, score, null, doc = best.settle()
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(plan.items[item]), pa.array(doc, mask=null > 0), pa.array(score)],
                                             names=["item", "doc_id", "score"])

    return frequencies.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with a score above 0 of every item."""
    spark = docs.sparkSession
    terms = stored(in_blocks(item_terms(items), BLOCK_TERMS), "item-terms")
    plans = stored(mine(terms), "plans")
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for block in [r["block"] for r in plans.select("block").sort("block").collect()]:   # one plan at a time
        plan = Plan.read(plans.filter(F.col("block") == block).first()["plan"])
        frequencies = stored(extract(docs, plan), "frequencies")
        statistics = Statistics(frequencies, len(plan.terms))
        found = found.unionByName(stored(rank(frequencies, plan, statistics, top), "best"))
    names = terms.select(F.col("item").alias("of"), "item_id").distinct()
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(names, F.col("item") == F.col("of")).select("item_id", "rank", "doc_id", "score")
