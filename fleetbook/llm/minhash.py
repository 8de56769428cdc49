"""MinHash near-duplicate groups with tensored banding.

A document's set holds the 64-bit hashes of its distinct shingles of ``rule.shingle`` words.  Two
collections of ``halves`` half-keys (``rows`` minhashes each) are computed per set; every pair of a half-key from
the first and one from the second is a table key, so ``halves**2`` tables of ``2 * rows`` minhashes
cost ``2 * halves * rows`` minhashes.  Equal sets are one class, found by digest first.

Candidates are confirmed on the full sets.  Members of a table bucket are first compared with the
bucket's smallest member only.  What this leaves undecided - members of one bucket in different
components - is compared exactly, by a prefix-filter join over the sets of the documents
concerned: two sets that reach the similarity share one of their rarest shingles, and neither
has more shingles of its own than the similarity allows.  So no bucket is capped and no pair of a
bucket is left out, and documents that are far from all others (whose rarest shingles are their
own) make no pairs.

Defined cases: null or empty text and text without words has an empty set, linked with nothing;
texts of fewer words than a shingle are one shingle; rows with a null id are a group of their own each,
with a null component; repeated ids are one node per distinct set and share the id; extra
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.llm.common import (LOWER, U64, _splitmix, batch_bytes, mix64, prefix_hash, span_hash, stored, tokens,
                                  with_ids)
from fleetbook.llm.graph import components


class Rule(NamedTuple):
    """Words of a shingle, least Jaccard similarity (a fraction), and the bands to find it."""
    shingle: int = 3
    similarity: tuple[int, int] = (85, 100)
    halves: int = 9
    rows: int = 3


#: The rule of the op7 query.
RULE = Rule()


def shingle_sets(column, width: int = RULE.shingle) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch of texts: (values, bounds); values[bounds[i]:bounds[i+1]]
    are those of text i, ascending."""
    data, offsets = batch_bytes(column)
    step = _splitmix(width + 1, 0x5417)
    n = len(offsets) - 1
    data = LOWER[data]
    doc, start, end = tokens(data, offsets)
    word = span_hash(prefix_hash(data), start, end)
    with np.errstate(over="ignore"):
        grams, owner = [], []
        count = np.bincount(doc, minlength=n)
        for size in range(1, width + 1):
            k = len(word) - size + 1
            if k <= 0:
                continue
            same = doc[:k] == doc[size - 1:]
            if size < width:                       # a text of fewer words is one shingle
                same &= count[doc[:k]] == size
            at = np.flatnonzero(same)
            h = np.full(len(at), step[0] * U64(size), dtype=U64)
            for j in range(size):
                h = mix64(h + word[at + j] * (step[j + 1] | U64(1)))
            grams.append(h)
            owner.append(doc[at])
    values = np.concatenate(grams) if grams else np.zeros(0, U64)
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(n + 1))


def sketches(values: np.ndarray, bounds: np.ndarray, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set: two digest words and the 2 * rule.halves half-keys (0 for empty sets)."""
    n = len(bounds) - 1
    some = np.flatnonzero(np.diff(bounds))
    seeds = _splitmix(2 * 2 * rule.halves * rule.rows, 0xD0C5).reshape(2, -1)
    half = np.zeros((n, 2 * rule.halves), dtype=U64)
    d1, d2 = np.zeros(n, U64), np.zeros(n, U64)
    if len(some):
        cut = bounds[some]
        with np.errstate(over="ignore"):
            d1[some] = np.add.reduceat(mix64(values + U64(1)), cut)
            d2[some] = np.bitwise_xor.reduceat(mix64(values ^ U64(0xA5A5A5A5A5A5A5A5)), cut)
            for k in range(2 * rule.halves):
                h = np.full(len(some), U64(k + 1))
                for r in range(rule.rows):
                    j = k * rule.rows + r
                    h = mix64(h * U64(3) + np.minimum.reduceat(values * (seeds[0, j] | U64(1)) + seeds[1, j], cut))
                half[some, k] = h
    return d1, d2, half


SKETCH = "doc_id long, digest string, n long, d1 long, d2 long, half array<long>"


def text_digest():
    """Tells apart the texts of rows that repeat an id."""
    return F.md5(F.coalesce("text", F.lit("")))


def sketch_documents(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    def run(batches):
        for batch in batches:
            values, bounds = shingle_sets(batch.column("text"), rule.shingle)
            d1, d2, half = sketches(values, bounds, rule)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, half.size + 1, 2 * rule.halves, dtype=np.int32)),
                                             pa.array(half.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(bounds).astype(np.int64)),
                 pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], names=["doc_id", "digest", "n", "d1", "d2", "half"])
    return docs.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), "text").mapInArrow(run, SKETCH)


def document_sets(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, n, d1, d2, items): the shingle hashes of ``docs`` (doc_id, text), ascending, with their digest."""
    def run(batches):
        for batch in batches:
            values, bounds = shingle_sets(batch.column("text"), rule.shingle)
            d1, d2, _ = sketches(values, bounds, rule)
            items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(d1.view(np.int64)),
                                              pa.array(d2.view(np.int64)), items], names=["doc_id", "n", "d1", "d2", "items"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, items array<long>")


def table_keys(classes: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(key, rep, low, n): halves**2 table keys per class, one of each pair of half-keys."""
    first = F.posexplode(F.slice("half", 1, rule.halves)).alias("i", "ha")
    second = F.posexplode(F.slice("half", rule.halves + 1, rule.halves)).alias("j", "hb")
    return classes.select("rep", "low", "n", "half", first).select("rep", "low", "n", "i", "ha", second) \
        .select(F.xxhash64("i", "j", "ha", "hb").alias("key"), "rep", "low", "n")


def confirm(pairs: DataFrame, sets: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; ``sets`` is a stored table."""
    num, den = rule.similarity
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    both = both.select("a", "b", common.cast("long").alias("common"),
                       (F.size("items_a") + F.size("items_b")).cast("long").alias("sizes"))
    return both.filter(den * F.col("common") >= num * (F.col("sizes") - F.col("common"))).select("a", "b")


def similar_size(x, y, rule: Rule = RULE):
    num, den = rule.similarity
    return (den * x >= num * y) & (den * y >= num * x)


def rest_pairs(sets: DataFrame, label: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Pairs of sets in different components that may reach the similarity (prefix filter).

    ``sets`` (rep, n, items), ``label`` (rep, comp), both stored.
    """
    num, den = rule.similarity
    items = sets.select("rep", F.explode("items").alias("item"))
    often = stored(items.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1"), "item-df")
    shared = items.join(often, "item").groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("df", "item"))).alias("shared"))
    have = stored(sets.select("rep", "n").join(shared, "rep").join(label, "rep"), "rest")
    # own = n - shared items occur in no other set; a prefix has n - ceil(similarity * n) + 1 items, own
    # first; ``after``: how many items of the set, this one included, follow in the order.  A pair
    # has at most as many items in common as follow, in either set, the first one they share.
    need = F.ceil(num * F.col("n") / F.lit(den))
    have = have.withColumn("n_shared", F.size("shared").cast("long")).filter(F.col("n_shared") >= need)
    prefix = (F.col("n") - need + 1) - (F.col("n") - F.col("n_shared"))
    rows = have.select("rep", "comp", "n", "n_shared", F.posexplode(F.slice("shared", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("k", "p")) \
        .select("rep", "comp", "n", (F.col("n_shared") - F.col("k")).alias("after"), F.col("p.item").alias("item"))
    rows = stored(rows, "rest-prefix")
    # items in sets of one component only have nothing to decide; elsewhere the commonest component
    # of an item is compared with the others, and the others among themselves
    per = rows.groupBy("item", "comp").agg(F.count("*").alias("cnt"))
    main = stored(per.groupBy("item").agg(F.max_by("comp", F.struct("cnt", "comp")).alias("main"), F.count("*").alias("kinds"))
                  .filter("kinds > 1").select("item", "main"), "rest-main")
    rows = stored(rows.join(main, "item"), "rest-rows")
    x = rows.filter("comp <> main").select("item", "main", F.col("rep").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("after").alias("ax"))
    y = rows.select("item", F.col("rep").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("after").alias("ay"))
    together = (num * (F.col("nx") + F.col("ny"))) / F.lit(num + den)      # least number of common items
    hit = x.join(y, "item").filter((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y")))
                                   & similar_size(F.col("nx"), F.col("ny"), rule)
                                   & (F.col("ax") >= together) & (F.col("ay") >= together))
    return hit.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, digest (of the text).

    A class is a distinct set, numbered on its own: of rows that repeat an id each belongs to the
    class of its text.
    """
    sketch = stored(sketch_documents(docs, rule), "sketch")
    some = sketch.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("low"), F.first("half").alias("half"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keys = table_keys(classes, rule)
    # a bucket's hub is the class of its smallest id: mostly the text that the others were copied from
    hubs = stored(keys.groupBy("key").agg(F.min(F.struct("low", "rep")).alias("first"), F.min("rep").alias("one"), F.max("rep").alias("far"))
                  .filter("one < far").select(F.col("key").alias("k2"), F.col("first.rep").alias("hub")), "hubs")
    met = keys.join(hubs, F.col("key") == F.col("k2")).select("rep", "hub").distinct()
    met = stored(met, "met")
    wanted = stored(met.select("rep").distinct(), "wanted")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the text of a class is that of its smallest id with the class's digest
    asked = classes.join(wanted, "rep").select("rep", F.col("low").alias("doc_id"), "n", "d1", "d2")
    asked = stored(asked, "asked")
    sets = document_sets(with_ids(text, "doc_id", stored(asked.select("doc_id").distinct(), "wanted-ids")), rule)
    sets = sets.filter("n > 0").groupBy("doc_id", "n", "d1", "d2").agg(F.first("items").alias("items"))
    sets = stored(sets.join(asked, ["doc_id", "n", "d1", "d2"]).select("rep", "n", "items"), "sets")
    size = sets.select("rep", "n")
    near = met.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")) \
        .join(size.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a") \
        .join(size.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b").filter(similar_size(F.col("na"), F.col("nb"), rule))
    links = stored(confirm(near, sets, rule), "links")
    comp = stored(components(links), "comp")
    label = stored(size.select("rep").join(comp, F.col("rep") == F.col("node"), "left")
                   .select("rep", F.coalesce("component", "rep").alias("comp")), "label")
    # buckets whose members are not all in one component yet: their documents are compared exactly
    named = label.select(F.col("rep").alias("r3"), "comp")
    open_hubs = stored(met.join(named, F.col("rep") == F.col("r3")).groupBy("hub").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
                       .filter("c1 < c2").select(F.col("hub").alias("h2")), "open")
    undecided = met.join(open_hubs, F.col("hub") == F.col("h2"), "left_semi").select(F.col("rep").alias("r4")).distinct()
    rest = stored(sets.join(undecided, F.col("rep") == F.col("r4"), "left_semi"), "rest-sets")
    more = confirm(rest_pairs(rest, label, rule), rest, rule)
    final = stored(components(links.unionByName(stored(more, "links"))), "comp")
    found = stored(classes.select("n", "d1", "d2", "low", "rep").join(final, F.col("rep") == F.col("node"), "left")
                   .select("n", "d1", "d2", "low", F.coalesce("component", "rep").alias("comp")), "class-components")
    low = found.groupBy(F.col("comp").alias("of_comp")).agg(F.min("low").alias("component_id"))
    of = found.join(low, F.col("comp") == F.col("of_comp")).select(
        F.col("n").alias("n2"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "component_id")
    out = sketch.join(of, (F.col("n") == F.col("n2")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
                      & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "digest")
