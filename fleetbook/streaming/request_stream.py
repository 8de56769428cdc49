"""Apply streams of request files to the inventory tables, micro-batch by micro-batch.

``readStream`` over a folder of JSON request files (one operation per folder) feeds
``foreachBatch``: each micro-batch is applied with the same batch operator as the offline
path, to the tables left by the last committed batch of any operation.  Tables live in a
``BucketStore``: the batch's keys tell which buckets it can change (``FOOTPRINTS``); only these are
written again, operators that need no other bucket read only these, and operators that only
insert add their rows to the buckets instead.  An operation without a footprint rewrites what
it changes as a whole.

A commit is known by (stream, epoch), where ``stream`` is the id in the stream's checkpoint: a
failed or retried epoch (Spark re-runs it with the same id) overwrites its own folder and commits
once; a stream of the same operation with a new checkpoint commits anew.  Lines that are no request
are kept in ``_rejects`` with their text.

Files are taken oldest first; with ``maxFilesPerTrigger`` the order across files is arrival
order, and inside a micro-batch the operator orders by ``seq``.  Order *across operations* is
the trigger order of their streams, not ``seq``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetbook.plans.batch import Changes, new_id
from fleetbook.plans.joins import mentioned
from fleetbook.plans.session import scratch_table
from fleetbook.sources.catalog_tables import BUCKET_KEYS
from fleetbook.sources.requests import from_json_names, json_schema
from fleetbook.sources.schemas import SPEC_TABLE
from fleetbook.sources.tables import Tables, load_tables
from fleetbook.streaming import bucket_store as store
from fleetbook.streaming.bucket_store import BucketStore

REJECT_SCHEMA = "operation string, epoch long, seq long, reason string, line string"
MALFORMED = "malformed request"


# ------------------------------------------------------------------------------------ footprints


@dataclass(frozen=True)
class Footprint:
    """Which rows a batch can change: ``keys`` of (tables, requests) are the bucket keys of all of
    them; ``local`` tables are read in these buckets only, everything else whole."""

    keys: Callable[[Tables, DataFrame], DataFrame]
    local: tuple[str, ...] = ()


def _named(column: str) -> Callable[[Tables, DataFrame], DataFrame]:
    return lambda t, req: req.select(column)


def _inserted(operation: str, attr: str) -> Callable[[Tables, DataFrame], DataFrame]:
    return lambda t, req: req.select(new_id(operation, "seq", getattr(t, attr).schema["id"].dataType).alias("id"))


def _by_email(t: Tables, req: DataFrame) -> DataFrame:
    return mentioned(t.users, "email", req, "email").select("id")


ASSET_TABLES = ("assets", "employee_asset_relation", *SPEC_TABLE.values())
FOOTPRINTS = {
    "register_assets": Footprint(_inserted("register_asset", "assets"), ASSET_TABLES),
    "update_assets": Footprint(_named("id"), ASSET_TABLES),
    "update_warranty": Footprint(_named("asset_id"), ASSET_TABLES),
    "assign_assets": Footprint(_named("asset_id"), ASSET_TABLES),
    "reassign_assets": Footprint(_named("asset_id"), ASSET_TABLES),
    "retrieve_assets": Footprint(_named("asset_id"), ASSET_TABLES),
    "delete_assets": Footprint(_named("id"), ASSET_TABLES),
    "asset_log": Footprint(_named("asset_id"), ASSET_TABLES),
    "upsert_employees": Footprint(_inserted("employee", "employee")),
    "update_employees": Footprint(_named("id")),
    "delete_employees": Footprint(_named("employee_id")),
    "register_users": Footprint(_inserted("user", "users")),
    "update_users": Footprint(_named("id")),
    "set_access_type": Footprint(_named("user_id")),
    "set_profile_image": Footprint(_named("user_id")),
    "logout_users": Footprint(_named("user_id"), ("sessions",)),
    "login_attempts": Footprint(_by_email, ("sessions",)),
}


def _unnamed_specs(batch: DataFrame) -> set[str]:
    """Specification tables of families that no request of the batch names."""
    if "asset_type" not in batch.columns:
        return set()
    families = {r["asset_type"] for r in batch.filter(F.col("asset_type").isin(*SPEC_TABLE)).select("asset_type").distinct().collect()}
    return {table for family, table in SPEC_TABLE.items() if family not in families}


# ------------------------------------------------------------------------------------- reading


def committed(spark: SparkSession, out_root: str, stream: str, epoch_id: int) -> bool:
    log = store.read_log(spark, out_root)
    return log is not None and not log.filter(
        (F.col("stream") == stream) & (F.col("epoch") == epoch_id) & (F.col("action") == store.COMMIT)).isEmpty()


def current_tables(spark: SparkSession, base_dir: str, out_root: str) -> Tables:
    """Tables as of the last commit (the base tables where there is none)."""
    if store.last_version(store.read_log(spark, out_root)) < 1:
        return load_tables(spark, base_dir)
    return BucketStore(spark, base_dir, out_root).tables()


def _paths(spark: SparkSession, out_root: str, action: str, name: str) -> list[str]:
    log = store.read_log(spark, out_root)
    if log is None:
        return []
    rows = log.filter((F.col("action") == action) & (F.col("name") == name) & (F.col("stream") != store.BASE))
    return [r["path"] for r in rows.select("path").collect()]       # one per batch


def rejects(spark: SparkSession, out_root: str) -> DataFrame:
    """Rejected requests and malformed lines of all committed batches."""
    roots = _paths(spark, out_root, store.COMMIT, store.VERSIONS)
    if not roots:
        return spark.createDataFrame([], REJECT_SCHEMA)
    return spark.read.schema(REJECT_SCHEMA).parquet(*[f"{r}/_rejects" for r in roots])


def emitted(spark: SparkSession, out_root: str, name: str) -> DataFrame | None:
    """What all committed batches put out under ``name`` (an output that is no table)."""
    paths = _paths(spark, out_root, store.OUTPUT, name)
    return spark.read.parquet(*paths) if paths else None


# ------------------------------------------------------------------------------------ applying


def apply_micro_batch(batch: DataFrame, epoch_id: int, operator: Callable[[Tables, DataFrame], Changes],
                      base_dir: str, out_root: str, operation: str = "requests", stream: str | None = None,
                      buckets: int = 64) -> bool:
    """Apply one micro-batch to the last committed tables and commit a new version.

    Returns False (and changes nothing) when (``stream``, ``epoch_id``) is already committed: Spark
    re-runs an epoch after a failure between the commit and its own checkpoint, and applying
    the same requests twice would, e.g., close relations twice.  ``stream`` defaults to the operation,
    for callers that apply batches of their own numbering.
    """
    spark = batch.sparkSession
    stream, epoch = stream or operation, int(epoch_id)
    if committed(spark, out_root, stream, epoch):
        return False
    with scratch_table(batch, "batch") as stored:       # its lines are parsed once, however often operators read them
        _apply(stored, epoch, operator, BucketStore(spark, base_dir, out_root, buckets), operation, stream)
    return True


def _apply(batch: DataFrame, epoch: int, operator: Callable[[Tables, DataFrame], Changes], tables: BucketStore,
           operation: str, stream: str) -> None:
    spark, out_root = tables.spark, tables.out_root
    version = 1 + store.last_version(store.read_log(spark, out_root))
    bad = None
    if "_corrupt_record" in batch.columns:
        bad = batch.filter(F.col("_corrupt_record").isNotNull()).select(
            F.lit(None).cast("long").alias("seq"), F.lit(MALFORMED).alias("reason"), F.col("_corrupt_record").alias("line"))
        batch = batch.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    footprint = FOOTPRINTS.get(operation)
    touched = unnamed = None
    if footprint is None:
        changes = operator(tables.tables(), batch)
        for name in changes.tables:
            if name in BUCKET_KEYS:
                tables.bucketed(name)
    else:
        touched = tables.buckets_of(footprint.keys(tables.tables(), batch))
        unnamed = _unnamed_specs(batch)
        whole = len(touched) == tables.buckets
        plan = operator(tables.tables(), batch)                      # a plan; nothing is computed here
        for name in plan.tables:
            # a table of which every bucket is replaced now needs no copy before
            if name in BUCKET_KEYS and name not in unnamed and not (whole and name not in plan.appended):
                tables.bucketed(name)
        changes = operator(tables.tables(dict.fromkeys(footprint.local, touched)), batch)
    root = f"{out_root}/stream={stream}/epoch={epoch}"
    rows = [(version, stream, operation, epoch, store.VERSIONS, store.COMMIT, tables.buckets, root)]
    for name, df in changes.tables.items():
        path = f"{root}/{name}"
        if name not in BUCKET_KEYS:                                # an output of the batch that is no table
            df.write.mode("overwrite").parquet(path)
            rows.append((version, stream, operation, epoch, name, store.OUTPUT, -1, path))
        elif name in (unnamed or ()):
            continue
        elif name in changes.appended:
            held = store.write_buckets(changes.appended[name], BUCKET_KEYS[name], tables.buckets, path)
            rows += [(version, stream, operation, epoch, name, store.ADD, b, f"{path}/bucket={b}") for b in held]
        else:
            if touched is not None:
                df = df.filter(store.bucket_of(F.col(BUCKET_KEYS[name]), tables.buckets).isin(*touched)) if touched else df.limit(0)
            held = set(store.write_buckets(df, BUCKET_KEYS[name], tables.buckets, path))
            rows += [(version, stream, operation, epoch, name, store.REPLACE, b, f"{path}/bucket={b}" if b in held else "")
                     for b in (range(tables.buckets) if touched is None else touched)]
    refused = changes.rejects.select("seq", "reason", F.lit(None).cast("string").alias("line"))
    refused = refused if bad is None else refused.unionByName(bad)
    refused.select(F.lit(operation).alias("operation"), F.lit(epoch).cast("long").alias("epoch"), "seq", "reason", "line") \
        .write.mode("overwrite").parquet(f"{root}/_rejects")
    store.append_log(spark, out_root, rows)


def stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id that Spark keeps in a stream's checkpoint: new with every new checkpoint folder."""
    return json.loads(spark.read.text(f"{checkpoint_dir}/metadata").first()["value"])["id"]


def apply_request_stream(spark: SparkSession, op: str, operator: Callable[[Tables, DataFrame], Changes],
                         requests_dir: str, base_dir: str, out_root: str, checkpoint_dir: str,
                         max_files_per_trigger: int = 1, available_now: bool = True,
                         buckets: int = 64) -> StreamingQuery:
    """Start the stream; returns the running query (``awaitTermination`` to finish).  ``buckets`` counts when
    the store is made."""
    raw = (spark.readStream.schema(json_schema(op)).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .json(requests_dir))
    requests = from_json_names(raw, op)

    def apply_batch(batch: DataFrame, epoch_id: int) -> None:
        apply_micro_batch(batch, epoch_id, operator, base_dir, out_root, op, stream_id(spark, checkpoint_dir), buckets)

    writer = requests.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
