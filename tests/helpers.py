"""Tiny hand-made inventory tables for unit tests."""
import datetime as dt

from fleetbook.sources.schemas import table_schema
from fleetbook.sources.tables import ATTR_TO_TABLE, Tables

D = dt.date
TS = dt.datetime


def frame(spark, table, rows):
    """rows: list of dicts with a subset of the table's columns."""
    schema = table_schema(table)
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def tables(spark, **given):
    """Tables with the given attr -> list-of-dict rows; others empty."""
    out = {}
    for attr, name in ATTR_TO_TABLE.items():
        out[attr] = frame(spark, name, given.get(attr, []))
    return Tables(**out)


def rows(df, *cols, order=None):
    sel = df.select(*cols) if cols else df
    got = [tuple(r) for r in sel.collect()]
    return sorted(got, key=repr) if order is None else got
