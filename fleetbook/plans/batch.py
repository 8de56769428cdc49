"""Set-at-a-time application of request batches, equal to applying them one by one.

Rules (per operation):
* last-wins:  per key, the request with the highest ``seq`` decides (full column set).
* first-wins: per key, the lowest ``seq`` closes/archives the row; later ones match nothing.
* append-all: every accepted request inserts a row.
* guard first: guards read only tables the operation does not modify, so they are
  evaluated once against the stored tables, before the batch.

Reductions use ``max_by``/``min_by`` (partial aggregates): a key with a large share of the
requests is reduced on the map side, never ranked in one window partition.  The reduced
side has one row per key, and the target stays the preserved side of the outer join, so a
hot key in the target can be split by AQE.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Go zero value of a date, used when a request leaves it out (NULL in the request frame).
ZERO_DATE = "0001-01-01"


@dataclass(frozen=True)
class Changes:
    """Result of a write operator: the new tables it changed and the rejected requests.

    ``appended`` holds, for tables that only got new rows, these rows alone.
    """

    tables: dict[str, DataFrame]
    rejects: DataFrame
    appended: dict[str, DataFrame] = field(default_factory=dict)


def winners(requests: DataFrame, keys: list[str], last: bool = True, seq: str = "seq") -> DataFrame:
    """One request per key: the highest ``seq`` (last-wins) or the lowest (first-wins)."""
    payload = F.struct(*[F.col(c) for c in requests.columns if c not in keys])
    pick = F.max_by(payload, F.col(seq)) if last else F.min_by(payload, F.col(seq))
    return requests.groupBy(*keys).agg(pick.alias("__w")).select(*keys, "__w.*")


def matched_update(target: DataFrame, chosen: DataFrame, on: list[tuple[str, str]],
                   sets: dict[str, Column], guard: Column | None = None,
                   prefix: str = "r_") -> DataFrame:
    """``UPDATE target SET ... FROM chosen WHERE keys match AND guard``.

    ``chosen`` has at most one row per key; its columns are visible in ``sets`` and ``guard``
    as ``prefix + name``.  Rows without a match, or failing the guard, are unchanged.
    """
    renamed = chosen.select(*[F.col(c).alias(prefix + c) for c in chosen.columns])
    cond = None
    for t_col, r_col in on:
        c = target[t_col] == renamed[prefix + r_col]
        cond = c if cond is None else cond & c
    j = target.join(renamed, cond, "left")
    hit = F.col(prefix + on[0][1]).isNotNull()
    if guard is not None:
        hit = hit & F.coalesce(guard, F.lit(False))
    out = []
    for f in target.schema.fields:
        if f.name in sets:
            out.append(F.when(hit, sets[f.name].cast(f.dataType))
                       .otherwise(target[f.name]).alias(f.name))
        else:
            out.append(target[f.name])
    return j.select(*out)


def new_id(op: str, seq: Column | str, id_type: T.DataType = T.LongType()) -> Column:
    """Deterministic id of a row inserted by request ``seq`` of operation ``op``.

    Stable under recomputation (unlike ``uuid()``), so a retried task writes the same ids.
    """
    s = F.col(seq) if isinstance(seq, str) else seq
    if isinstance(id_type, T.StringType):
        return F.sha2(F.concat_ws("|", F.lit(op), s.cast("string")), 256)
    return F.xxhash64(F.lit(op), s)


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejects(seq, reason)) for a NULL-when-fine ``reason`` column."""
    tagged = df.withColumn("__reason", reason)
    ok = tagged.filter(F.col("__reason").isNull()).drop("__reason")
    bad = tagged.filter(F.col("__reason").isNotNull()).select(
        F.col("seq").cast("long").alias("seq"), F.col("__reason").alias("reason"))
    return ok, bad


def chain_next(df: DataFrame, key: str, order: str, payload: list[str], width: int = 1 << 16,
               name: str = "__next") -> DataFrame:
    """``df`` plus ``name`` = the payload struct of the next row (by ``order``) with the same
    ``key``; NULL for the last row of a key.  Same as ``lead`` over ``partitionBy(key)``.

    A key holding a large share of the rows would put its whole run in one window partition.
    Here the window runs per (key, order // width) bucket, so a group holds at most ``width``
    consecutive order values; the last row of each bucket takes the first row of the key's
    next non-empty bucket, found by a second ``lead`` over the bucket heads (``width`` times
    fewer rows).  ``order`` must be unique within a key.
    """
    bucket = F.floor(F.col(order) / F.lit(width)).cast("long")
    body = F.struct(*[F.col(c) for c in payload])
    b = df.withColumn("__bucket", bucket)
    inner = b.withColumn(name, F.lead(body).over(Window.partitionBy(key, "__bucket").orderBy(order)))
    heads = (b.groupBy(key, "__bucket")
             .agg(F.min_by(body, F.col(order)).alias("__head"))
             .withColumn("__next_head", F.lead("__head").over(Window.partitionBy(key).orderBy("__bucket")))
             .select(F.col(key).alias("__hk"), F.col("__bucket").alias("__hb"), "__next_head"))
    j = inner.join(heads, (inner[key] == heads["__hk"]) & (inner["__bucket"] == heads["__hb"]), "left")
    return (j.withColumn(name, F.coalesce(F.col(name), F.col("__next_head")))
            .drop("__bucket", "__hk", "__hb", "__next_head"))


def apply_in_order(tables, steps, cut_every: int = 1):
    """Apply ``(operator, requests)`` steps in order, each on the tables left by the previous.

    Returns ``(tables, rejects)`` with rejects tagged by ``step`` (1-based).  Every
    ``cut_every`` steps the changed tables are checkpointed into the shared checkpoint folder
    (reliable, survives executor loss), so a long pipeline does not grow one ever-deeper plan.
    ``cut_every=0`` keeps everything lazy.
    """
    from fleetbook.plans.session import cut_lineage
    from fleetbook.sources.tables import TABLE_TO_ATTR

    rejects = None
    for i, (operator, requests) in enumerate(steps, 1):
        ch = operator(tables, requests)
        changed = {TABLE_TO_ATTR[n]: df for n, df in ch.tables.items() if n in TABLE_TO_ATTR}
        if cut_every and i % cut_every == 0:
            changed = {a: cut_lineage(df) for a, df in changed.items()}
        tables = tables.with_(**changed)
        tagged = ch.rejects.withColumn("step", F.lit(i))
        rejects = tagged if rejects is None else rejects.unionByName(tagged)
    return tables, rejects
