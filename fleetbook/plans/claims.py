"""Unique values granted in request order.

A request gives a row (its *owner*) values of unique columns.  It is refused if another row holds one of
them at that moment; a granted request frees what its owner held before.  Whether a value is free may hang on
requests that are not decided yet, so decisions are taken in rounds over the open requests:

* a granted request holds its value *for sure* until its owner's next request for another value that is not refused, and
  *perhaps* until the next granted one; an open request perhaps holds it until then, too;
* an open request is refused if another owner holds one of its values for sure, granted if
  no other owner perhaps holds any.  The earliest open request is always decided.

Values that only one row holds or wants are granted beforehand and never enter a round.  The number
of rounds is the length of the longest chain of requests that wait for one another: a few where values
change hands a few times, but as many as requests where every one takes what the one before it has just freed.  A round is two scans along each owner's requests and two along each value's
(``plans.scan``): a value or an owner that a third of the batch names is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbook.plans.scan import WHOLE, WIDTH, first_after, last_before, running_sum
from fleetbook.plans.session import cut_lineage

#: Place of what is stored before the batch: before every ``seq``.
STORED = -(2 ** 63)
#: Two counts in one running sum: owners that perhaps hold a value, times this, plus those that do for sure.
PERHAPS = 1 << 32
NAME = ["kind", "value"]


def claims_of(requests: DataFrame, owner: Column, kinds: list[str]) -> DataFrame:
    """(seq, owner, kind, value): one row per request and unique column in ``kinds``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])
    return requests.select(F.col("seq").cast("long").alias("seq"), owner.cast("string").alias("owner"), F.explode(pairs).alias("pair")) \
        .select("seq", "owner", "pair.*").filter("value is not null")


def holders(table: DataFrame, kinds: dict[str, str], wanted: DataFrame) -> DataFrame:
    """(kind, value, owner) of the stored rows that hold a ``wanted`` (kind, value), in one pass over
    ``table``.  ``kinds`` gives each kind's value as SQL text, NULL where the row holds none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(v).cast("string").alias("value")) for k, v in kinds.items()])
    rows = table.select(F.col("id").cast("string").alias("owner"), F.explode(pairs).alias("pair")).select("pair.*", "owner")
    return cut_lineage(rows.join(wanted.select(*NAME).distinct(), NAME, "left_semi"))


def _timelines(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Claims and holdings (seq, owner, kind, value, fought, sure) of the owners that a fought value
    names; a request is open (not ``sure``) if any of its values is fought over."""
    held = held.select(F.lit(STORED).alias("seq"), "owner", *NAME)
    every = claims.select("seq", "owner", *NAME).unionByName(held)
    fought = every.groupBy(*NAME).agg(F.min("owner").alias("a"), F.max("owner").alias("b")).filter("a <> b")
    every = cut_lineage(every.join(fought.select(*NAME, F.lit(True).alias("fought")), NAME, "left")
                        .withColumn("fought", F.coalesce("fought", F.lit(False))))
    named = every.filter("fought")
    waiting = named.filter(F.col("seq") != STORED).select("seq", F.lit(False).alias("sure")).distinct()
    lines = every.join(named.select("kind", "owner").distinct(), ["kind", "owner"], "left_semi")
    return lines.join(waiting, "seq", "left").select("seq", "owner", *NAME, "fought", F.coalesce("sure", F.lit(True)).alias("sure"))


def _width(lines: DataFrame) -> int | None:
    """How to scan: keys whole if the largest one, counted, gives no more than WIDTH rows (a line changes the
    holders three times at most and asks once)."""
    keys = F.array(F.struct("kind", F.lit("owner").alias("of"), F.col("owner").alias("name")),
                   F.struct("kind", F.lit("value").alias("of"), F.col("value").alias("name")))
    largest = lines.select(F.explode(keys).alias("key")).groupBy("key").count().agg(F.max("count")).first()[0] or 0
    return WHOLE if 4 * largest <= WIDTH else None


def _dealt(df: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """``df`` dealt by ``keys`` if they are scanned whole: grouping and scans by more columns then move no row again."""
    return df.repartition(*keys) if width == WHOLE else df


def _met(lines: DataFrame, asked: DataFrame, width: int | None) -> DataFrame:
    """``asked`` claims plus ``n``: the other owners that hold the value then, as two counts."""
    def settled(df):            # a scan in buckets reads its input twice: cut, so that scans do not multiply
        return df if width == WHOLE else cut_lineage(df)

    order = ["kind", "owner"]
    rows = settled(first_after(lines, order, "seq", F.col("sure"), F.col("seq"), "sure_end", width))
    rows = settled(last_before(rows, order, "seq", F.lit(True), F.col("value"), "prior", width))
    rows = first_after(rows, order, "seq", F.coalesce(F.col("prior") != F.col("value"), F.lit(False)), F.col("seq"), "next", width).filter("fought")
    sure = F.col("sure").cast("long")
    changes = F.array(F.struct(F.col("seq").alias("at"), (F.lit(PERHAPS) + sure).alias("delta")),
                      F.struct(F.col("sure_end").alias("at"), F.lit(-PERHAPS).alias("delta")),
                      F.struct(F.col("next").alias("at"), (-sure).alias("delta")))
    moments = rows.select(*NAME, "owner", F.explode(changes).alias("c")).select(*NAME, "owner", "c.*", F.lit(False).alias("asked")).filter("at is not null")
    moments = _dealt(moments.unionByName(asked.select(*NAME, "owner", F.col("seq").alias("at"), F.lit(0).cast("long").alias("delta"),
                                                      F.lit(True).alias("asked"))), NAME, width)
    moments = settled(moments.groupBy(*NAME, "owner", "at").agg(F.sum("delta").alias("delta"), F.max("asked").alias("asked")))
    moments = settled(running_sum(moments, NAME, "at", F.col("delta"), "everybody", width))
    moments = running_sum(moments, [*NAME, "owner"], "at", F.col("delta"), "own", width)
    return moments.filter("asked").selectExpr(*NAME, "at as seq", "owner", "everybody - own as n")


def refusals(claims: DataFrame, held: DataFrame, width: int | None = None) -> DataFrame:
    """(seq, kind) of the claims on a value that another row holds when the request arrives; requests
    without one are granted.

    ``claims``: (seq, owner, kind, value), ``seq`` unique per request; ``held``: (kind, value, owner) as
    stored.  A granted request replaces its owner's value of the same kind.
    """
    claims = cut_lineage(claims)
    lines = cut_lineage(_timelines(claims, held))
    width = _width(lines) if width is None else width
    contested = lines.filter(F.col("fought") & (F.col("seq") != STORED)).select("seq", "owner", *NAME)
    while not lines.filter("not sure").isEmpty():
        met = _met(lines, lines.filter("fought and not sure").select("seq", "owner", *NAME), width)
        decided = met.groupBy("owner", "seq").agg(F.max(F.col("n") % PERHAPS > 0).alias("refused"), F.max(F.col("n") >= PERHAPS).alias("perhaps")) \
            .filter("refused or not perhaps").select("owner", "seq", "refused")
        # verdicts meet the lines of their request by owner, as which the next round's first scans want them
        told = _dealt(lines.unionByName(decided, allowMissingColumns=True), ["owner"], width)
        lines = told.withColumn("refused", F.max("refused").over(Window.partitionBy("owner", "seq"))).filter("kind is not null and (refused is null or not refused)")
        lines = cut_lineage(lines.select("seq", "owner", *NAME, "fought", (F.col("sure") | F.col("refused").isNotNull()).alias("sure")))
    refused = contested.join(lines.select("seq").distinct(), "seq", "left_anti")
    return cut_lineage(_met(lines, refused, width).filter("n > 0").select("seq", "kind"))
