"""Tables stored bucketed by their join keys in the session catalog (co-located joins).

Most operators group or join the relation table by ``asset_id`` and join it to ``assets`` on
``id``.  Stored with the same number of buckets on those keys, Spark reads both already
hash-partitioned: the per-asset aggregates and the asset joins run without a shuffle of the
largest table.  Specification tables follow the asset key, sessions the user key.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetbook.sources.tables import TABLE_TO_ATTR, Tables

# Bucketing key per stored table.
BUCKET_KEYS = {
    "users": "id",
    "employee": "id",
    "assets": "id",
    "employee_asset_relation": "asset_id",
    "laptop_specifications": "asset_id",
    "pen_drive_specifications": "asset_id",
    "hard_disk_specifications": "asset_id",
    "mobile_specifications": "asset_id",
    "sim_specifications": "asset_id",
    "sessions": "user_id",
}


def save_bucketed(tables: Tables, database: str, buckets: int) -> None:
    """Store every table as ``database.<table>``, bucketed and sorted by its key."""
    spark = tables.assets.sparkSession
    spark.sql(f"create database if not exists {database}")
    for name, df in tables.by_name().items():
        key = BUCKET_KEYS[name]
        # one task per bucket, so that a bucket is one file
        (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
         .saveAsTable(f"{database}.{name}"))


def load_bucketed(spark: SparkSession, database: str) -> Tables:
    """The tables of ``database`` (bucketing metadata comes from the catalog)."""
    return Tables(**{TABLE_TO_ATTR[name]: spark.table(f"{database}.{name}") for name in BUCKET_KEYS})
