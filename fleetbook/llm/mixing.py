"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 48-bit hash of its id.  A source that is to give a part of its
words takes the documents whose hash is below a threshold; the threshold is found by summing
words per source and hash bucket (1,024 buckets), locating the bucket in which the running sum
passes the budget, and refining only that bucket with the next ten bits, down to single hash
values.  Nothing is sorted but the bucket sums; the selection itself is a filter.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; null
ids share one hash; documents of equal hash (repeated ids) are taken together, and the group at
the threshold is taken if that comes nearer the budget than leaving it; an empty table gives an
empty mix; extra columns are carried along by ``apply_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbook.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5          # words of the mix, as a part of all words
MOST = 2.0           # a source, and so a document, is repeated at most so often
HASH_BITS = 48
STEP_BITS = 10       # each refinement resolves so many bits


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id) -> Column:
    """First 48 bits of md5(id as text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(slim: DataFrame) -> DataFrame:
    """One row per source: mix_source_size, mix_target.  ``slim`` has source, mix_size.

    The reshared excess has a closed form: with sources in ascending order of cap / weight and
    the budget and weight that remain after capping the earlier ones, the common level is the
    largest remaining budget per remaining weight.
    """
    sums = slim.groupBy("source").agg(F.sum("mix_size").alias("mix_source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())     # one row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(ranked) - 1) % len(WEIGHTS) + 1).cast("int"))
    sums = sums.withColumn("weight", weight.cast("long")).withColumn("place", F.row_number().over(ranked))
    earlier = Window.orderBy(F.col("mix_source_size") * MOST / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ((F.sum("mix_source_size").over(every) * SHARE - F.coalesce(F.sum("mix_source_size").over(earlier), F.lit(0)) * MOST)
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    return (sums.withColumn("level", level).withColumn("level", F.max("level").over(every))
            .select("source", "mix_source_size",
                    F.least(F.col("mix_source_size") * MOST, F.col("weight") * F.col("level")).alias("mix_target")))


def _on_source(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "mix_of")
    return left.join(right, left["source"].eqNullSafe(right["mix_of"])).drop("mix_of")


def mixing_plan(slim: DataFrame) -> DataFrame:
    """One row per source: mix_source_size, mix_target, mix_full (copies of every document) and
    mix_below (documents hashed below it get one copy more).  ``slim``: source, mix_key, mix_size."""
    size = F.col("mix_source_size")
    full = F.when(size > 0, F.floor(F.col("mix_target") / size)).otherwise(0).cast("long")
    plan = (source_targets(slim).withColumn("mix_full", full)
            .withColumn("left", F.col("mix_target") - F.col("mix_full") * size)
            .withColumn("mix_below", F.lit(0).cast("long")))
    bits = HASH_BITS
    while bits > 0:
        low = max(0, bits - STEP_BITS)
        plan = stored(plan, "mix-plan")
        plan = _refine(slim, plan, bits, low)
        bits = low
    return stored(plan, "mix-plan").drop("left")


def _refine(slim: DataFrame, plan: DataFrame, bits: int, low: int) -> DataFrame:
    """Move each source's threshold to the bucket of width 2**low that holds its budget."""
    inside = _on_source(slim, plan.select("source", "mix_below")) \
        .filter(F.shiftright("mix_key", bits) == F.shiftright("mix_below", bits))
    sums = inside.groupBy("source", F.shiftright("mix_key", low).alias("bucket")).agg(F.sum("mix_size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    sums = _on_source(sums, plan.select("source", "left")).filter(F.col("before") + F.col("words") > F.col("left"))
    at = sums.groupBy("source").agg(F.min(F.struct("bucket", "before", "words")).alias("at")) \
        .withColumnRenamed("source", "mix_of")
    out = plan.join(at, plan["source"].eqNullSafe(at["mix_of"]), "left").drop("mix_of")
    edge = F.col("at.bucket")
    if low == 0:   # single hash values: take the group at the edge if that comes nearer
        nearer = F.col("at.before") + F.col("at.words") - F.col("left") < F.col("left") - F.col("at.before")
        edge = edge + nearer.cast("long")
    return (out.withColumn("mix_below", F.coalesce(F.shiftleft(edge, low), "mix_below"))
            .withColumn("left", F.col("left") - F.coalesce("at.before", F.lit(0))).drop("at"))


def apply_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (source, mix_key and whatever else) with the plan's columns and mix_repeats."""
    copies = F.col("mix_full") + (F.col("mix_key") < F.col("mix_below")).cast("long")
    return _on_source(docs, plan).withColumn("mix_repeats", copies).drop("mix_full", "mix_below")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")      # names cannot clash inside
    taken = apply_plan(docs.select(row, "source", mix_key("doc_id").alias("mix_key")), mixing_plan(sized(docs)))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mix_repeats").cast("int")))
    return taken.select("row", copies).select("row.*")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mix_size, mix_key), stored: words are counted once."""
    return stored(docs.select("doc_id", "source", word_count("text").alias("mix_size"),
                              mix_key("doc_id").alias("mix_key")), "mix-sizes")
