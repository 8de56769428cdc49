"""Fleet dashboard: totals and per-type counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.sources.tables import Tables

# Dashboard columns per asset type, in output order.
TYPE_COLUMNS = (
    ("laptop", "laptop_quantity"),
    ("mouse", "mouse_quantity"),
    ("pen drive", "pen_drive_quantity"),
    ("hard disk", "hard_disk_quantity"),
    ("mobile", "mobile_quantity"),
    ("sim", "sim_quantity"),
)
TOTAL_COLUMNS = ("total_assets", "distributed_assets", "available_assets")


def _live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("archived_at").isNull())


def fleet_totals(t: Tables) -> DataFrame:
    """Live assets, open relations (any archive state), and their difference.

    ``available`` can go negative: relations are counted, not assets.  Both inputs are
    global aggregates (one row each); the second is read as a scalar subquery.
    """
    total = _live(t.assets).agg(F.count("id").alias("total_assets"))
    dist = (t.relation.filter(F.col("retrieved_date").isNull())
            .agg(F.count("asset_id").alias("distributed_assets")))
    d = dist.scalar()
    return total.select("total_assets", d.alias("distributed_assets"),
                        (F.col("total_assets") - d).alias("available_assets"))


def type_counts(t: Tables, scope: str = "total") -> DataFrame:
    """Six conditional counts over the scope's rows.

    total: live assets; available: live and available; distributed: live assets joined to
    relations still open (one count per relation); anything else: every asset row.
    """
    scope = scope or "total"
    if scope == "distributed":
        open_per_asset = (t.relation.filter(F.col("retrieved_date").isNull())
                          .groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")))
        a = _live(t.assets).select("id", "asset_type")
        j = a.join(open_per_asset, a["id"] == open_per_asset["asset_id"], "inner")
        return j.agg(*[F.coalesce(F.sum(F.when(F.col("asset_type") == k, F.col("n"))),
                                  F.lit(0)).cast("bigint").alias(c) for k, c in TYPE_COLUMNS])
    if scope == "total":
        a = _live(t.assets)
    elif scope == "available":
        a = _live(t.assets).filter(F.col("is_available") == F.lit(True))
    else:
        a = t.assets
    return a.agg(*[F.count_if(F.col("asset_type") == k).alias(c) for k, c in TYPE_COLUMNS])


def dashboard(t: Tables, scope: str = "total") -> DataFrame:
    """R11 then R12 as one row of nine columns (one-row aggregates, scalar subqueries).

    For the default 'total' scope the live-asset total and the six type counts come from one
    pass over ``assets``.
    """
    if (scope or "total") != "total":
        counts = type_counts(t, scope)
        row = counts.select(F.struct(*counts.columns).alias("c")).scalar()
        return fleet_totals(t).select("*", *[row[c].alias(c) for c in counts.columns])
    a = _live(t.assets).agg(
        F.count("id").alias("total_assets"),
        *[F.count_if(F.col("asset_type") == k).alias(c) for k, c in TYPE_COLUMNS])
    dist = (t.relation.filter(F.col("retrieved_date").isNull())
            .agg(F.count("asset_id").alias("distributed_assets")))
    d = dist.scalar()
    return a.select("total_assets", d.alias("distributed_assets"),
                    (F.col("total_assets") - d).alias("available_assets"),
                    *[c for _, c in TYPE_COLUMNS])
