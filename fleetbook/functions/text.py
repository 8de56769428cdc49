"""Scalar text helpers (all JVM-side built-ins, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INT_RE = r"^[+-]?[0-9]+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_text(col: Column | str) -> Column:
    """SHA-512 hex digest (the helper's comment says SHA-256; the code uses SHA-512)."""
    return F.sha2(_c(col), 512)


def trim_all(col: Column | str, ch: str) -> Column:
    """Remove every occurrence of the single character ``ch``."""
    return F.translate(_c(col), ch, "")


def trim_after(col: Column | str, delimiter: str) -> Column:
    """Text before the first ``delimiter``; the whole text when absent."""
    return F.substring_index(_c(col), delimiter, 1)


def phone_is_integer(col: Column | str) -> Column:
    """True when the text parses as a 64-bit signed integer with no surrounding spaces."""
    c = _c(col)
    return F.coalesce(c.rlike(_INT_RE) & c.try_cast("bigint").isNotNull(), F.lit(False))


def standardise_contacts(df: DataFrame, phone_col: str = "phone_no", email_col: str = "email",
                         password_col: str | None = None) -> DataFrame:
    """Contact clean-up as one column pipeline over a whole table.

    Adds ``phone_digits`` (spaces and dashes removed), ``phone_is_integer``, ``email_local``
    (text before '@') and, when ``password_col`` is given, ``password_hash`` (SHA-512 hex).
    """
    cols = [
        trim_all(trim_all(phone_col, " "), "-").alias("phone_digits"),
        phone_is_integer(phone_col).alias("phone_is_integer"),
        trim_after(email_col, "@").alias("email_local"),
    ]
    if password_col:
        cols.append(hash_text(password_col).alias("password_hash"))
    return df.select("*", *cols)
