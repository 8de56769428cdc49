"""The set of inventory tables as one immutable value, and its Parquet source/sink."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.sources.schemas import TABLE_NAMES, table_schema


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    employee: DataFrame
    assets: DataFrame
    relation: DataFrame  # employee_asset_relation
    laptop: DataFrame
    pen_drive: DataFrame
    hard_disk: DataFrame
    mobile: DataFrame
    sim: DataFrame
    sessions: DataFrame

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def by_name(self) -> dict[str, DataFrame]:
        return {stored: getattr(self, attr) for attr, stored in ATTR_TO_TABLE.items()}

    def spec(self, asset_type: str) -> DataFrame | None:
        attr = SPEC_ATTR.get(asset_type)
        return None if attr is None else getattr(self, attr)


ATTR_TO_TABLE = {
    "users": "users", "employee": "employee", "assets": "assets",
    "relation": "employee_asset_relation", "laptop": "laptop_specifications",
    "pen_drive": "pen_drive_specifications", "hard_disk": "hard_disk_specifications",
    "mobile": "mobile_specifications", "sim": "sim_specifications", "sessions": "sessions",
}
TABLE_TO_ATTR = {v: k for k, v in ATTR_TO_TABLE.items()}
SPEC_ATTR = {"laptop": "laptop", "pen drive": "pen_drive", "hard disk": "hard_disk",
             "mobile": "mobile", "sim": "sim"}

assert tuple(ATTR_TO_TABLE.values()) == TABLE_NAMES
assert [f.name for f in fields(Tables)] == list(ATTR_TO_TABLE)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, add absent ones as NULL.

    A spec table without its own ``id`` takes ``asset_id`` (one spec row per asset).
    """
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "id" and "asset_id" in present:
            cols.append(F.col("asset_id").cast(f.dataType).alias("id"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# What a column added by a later schema version holds in rows that were there before.
# Columns not named here were added without a default (``authentication_times`` got its 0 only
# afterwards, for new rows).
ADDED_COLUMNS = {
    "users": {"type": "authorized", "status": "white_listed"},
    "assets": {"is_available": True, "status": "available"},
    "employee": {"status": "active"},
}
# Enum values renamed later, (table, column) -> old and new.
RENAMED_VALUES = {("users", "status"): ("block_listed", "black_listed")}
# Tables that the first schema versions lack.
ADDED_TABLES = ("mobile_specifications", "sim_specifications")


def stored_columns(spark: SparkSession, path: str) -> set[str] | None:
    """Column names of a stored table from its file footers; None where there is no such folder,
    or no file in it."""
    try:
        return set(spark.read.parquet(path).columns)
    except AnalysisException as why:
        if why.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def load_table(spark: SparkSession, path: str, name: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """Read the table ``name`` from its folder, as ``load_tables`` does."""
    schema = table_schema(name, id_type)
    held = stored_columns(spark, path)
    if held is None and name in ADDED_TABLES:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    changes = {c: F.lit(v) for c, v in ADDED_COLUMNS.get(name, {}).items() if held is not None and c not in held}
    for (table, column), (old, new) in RENAMED_VALUES.items():
        if table == name and column not in changes:
            changes[column] = F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column))
    return df.withColumns(changes) if changes else df


def load_tables(spark: SparkSession, base_dir: str, id_type: T.DataType = T.LongType()) -> Tables:
    """Read ``base_dir/<table>`` Parquet directories with explicit schemas (no inference).

    A snapshot of an older schema version loads as if migrated: absent columns take the default
    they were added with (NULL without one), renamed enum values their new name, and
    specification tables of later families are empty.  Stored NULLs stay NULL.
    """
    return Tables(**{TABLE_TO_ATTR[n]: load_table(spark, f"{base_dir}/{n}", n, id_type) for n in TABLE_NAMES})


def write_snapshot(tables: Tables | dict[str, DataFrame], out_dir: str) -> str:
    """Write every table to a **new** version directory; the caller switches to it.

    Rows are never updated in place: a batch of writes yields a complete new snapshot, the
    Spark equivalent of committing the statements of a transaction together.
    """
    named = tables.by_name() if isinstance(tables, Tables) else tables
    for name, df in named.items():
        df.write.mode("errorifexists").parquet(f"{out_dir}/{name}")
    return out_dir
