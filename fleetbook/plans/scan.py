"""Segmented scans: what came before or comes after a row among the rows of its key.

A window per key would put a hot key's whole run into one task.  Here a key's run is cut into
buckets of ``WIDTH`` consecutive order values; windows run inside buckets, each bucket yields one summary
(its last or first matching row, or its sum), the summaries are scanned per key (``WIDTH`` times
fewer rows), and every row combines its bucket's carry with its own place.  ``order`` is unique
within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16
#: Width for keys that were counted: a key is one bucket.
WHOLE = 0


def _run(keys: list[str], width: int | None):
    """The rows that a window inside runs over.  Keys that are scanned whole are dealt by key alone, so that scans over
    more columns after it find their rows together."""
    return Window.partitionBy(*keys) if width == WHOLE else Window.partitionBy(*keys, "__bucket")


def _with_carry(df: DataFrame, keys: list[str], order: str, inner: Column, summary: Column, carry: Column, combine,
                name: str, width: int | None) -> DataFrame:
    if width == WHOLE:
        return df.withColumn(name, combine(inner, F.lit(None)))
    width = width or WIDTH
    placed = df.withColumn("__bucket", F.floor(F.col(order) / F.lit(width)).cast("long"))
    heads = placed.groupBy(*keys, "__bucket").agg(summary.alias("__summary"))
    heads = heads.withColumn("__carry", carry).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col("__bucket").alias("__hb"), "__carry")
    rows = placed.withColumn("__inner", inner)
    same = F.col("__bucket") == F.col("__hb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    out = rows.join(heads, same, "left").withColumn(name, combine(F.col("__inner"), F.col("__carry")))
    return out.drop("__bucket", "__hb", "__carry", "__inner", *[f"__h_{k}" for k in keys])


def last_before(df: DataFrame, keys: list[str], order: str, when: Column, payload: Column, name: str,
                width: int | None = None) -> DataFrame:
    """``df`` plus ``name``: ``payload`` of the last earlier row of the key where ``when`` holds."""
    hit = F.when(when, payload)
    inside = _run(keys, width).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return _with_carry(df, keys, order, F.last(hit, ignorenulls=True).over(inside), F.max_by(hit, F.when(when, F.col(order))),
                       F.last("__summary", ignorenulls=True).over(across), lambda own, carry: F.coalesce(own, carry), name, width)


def first_after(df: DataFrame, keys: list[str], order: str, when: Column, payload: Column, name: str,
                width: int | None = None) -> DataFrame:
    """``df`` plus ``name``: ``payload`` of the first later row of the key where ``when`` holds."""
    hit = F.when(when, payload)
    inside = _run(keys, width).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)
    return _with_carry(df, keys, order, F.first(hit, ignorenulls=True).over(inside), F.min_by(hit, F.when(when, F.col(order))),
                       F.first("__summary", ignorenulls=True).over(across), lambda own, carry: F.coalesce(own, carry), name, width)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int | None = None) -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` over the key's rows up to and including this one."""
    inside = _run(keys, width).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return _with_carry(df, keys, order, F.sum(value).over(inside), F.sum(value), F.sum("__summary").over(across),
                       lambda own, carry: own + F.coalesce(carry, F.lit(0)), name, width)
