"""Report and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

# JSON names of report columns whose name is not the camelCase of the column.
JSON_NAME_OVERRIDES = {
    "asset_type": "AssetType",
    "assigned_to_id": "assignedToID",
    "start_time": "lastLoginTime",
}


def camel(name: str) -> str:
    """snake_case column -> camelCase JSON name (``imei_1`` -> ``imei1``)."""
    if name in JSON_NAME_OVERRIDES:
        return JSON_NAME_OVERRIDES[name]
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def report_columns(df: DataFrame) -> DataFrame:
    """Rename report columns to the service's JSON names."""
    return df.select(*[df[c].alias(camel(c)) for c in df.columns])


# Timestamps keep microseconds (Spark's default JSON format stops at milliseconds).
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a report as JSON lines with the service's field names (one file per partition;
    nothing is gathered on the driver)."""
    report_columns(df).write.mode(mode).option("timestampFormat", TIMESTAMP_FORMAT).json(path)


def read_report(spark, path: str, schema) -> DataFrame:
    """Read a report written by ``write_report`` with an explicit schema (JSON field names)."""
    return spark.read.schema(schema).option("timestampFormat", TIMESTAMP_FORMAT).json(path)


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Multi-row insert: the new rows appended by column name (types follow the target)."""
    return target.unionByName(rows.select(*[rows[c].cast(target.schema[c].dataType).alias(c)
                                            for c in target.columns if c in rows.columns]),
                              allowMissingColumns=True)


def append_to_table(rows: DataFrame, path: str, batch: int) -> None:
    """Append ``rows`` to the Parquet table at ``path`` as batch number ``batch``.

    A batch is a folder of its own; existing ones are untouched.  Repeating a batch (after a failure,
    or twice) replaces its folder, so its rows stand in the table once.  The same number must
    mean the same rows.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def read_appended(spark, path: str, schema) -> DataFrame:
    """The rows of all batches appended to ``path``."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
