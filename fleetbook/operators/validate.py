"""Request validation as whole-frame column rules (V1-V4).

Each ``*_errors`` function returns an ``array<string>`` column with the failing field names
in declaration order (empty when valid).  ``error_message`` renders the reference's one-line
message: "Invalid <last failing field>".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.sources.schemas import (ASSET_TYPES, EMPLOYEE_STATUSES, EMPLOYEE_TYPES, OWNED_BY,
                                       USER_TYPES)

# The numeric rule of the phone validator and a documented simple e-mail rule.
NUMERIC_RE = r"^[-+]?[0-9]+(\.[0-9]+)?$"
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_LENGTH = 10
PASSWORD_MIN = 6


def _missing_str(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _missing(c: str) -> Column:
    return F.col(c).isNull()


def _errors(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def asset_create_errors() -> Column:
    """V1 (create): brand, type, the three dates required; type and ownership in domain."""
    return _errors([
        ("Brand", _missing_str("brand")),
        ("AssetType", _missing_str("asset_type") | ~F.coalesce(F.col("asset_type").isin(*ASSET_TYPES), F.lit(False))),
        ("PurchasedDate", _missing("purchased_date")),
        ("WarrantyStartDate", _missing("warranty_start_date")),
        ("WarrantyExpiryDate", _missing("warranty_expiry_date")),
        ("OwnedBy", ~F.coalesce(F.col("owned_by").isin(*OWNED_BY), F.lit(False))),
    ])


def asset_update_errors() -> Column:
    """V1 (update): brand, purchased_date, id and type required."""
    return _errors([
        ("Brand", _missing_str("brand")),
        ("PurchasedDate", _missing("purchased_date")),
        ("ID", _missing_str("id")),
        ("AssetType", _missing_str("asset_type")),
    ])


def phone_bad(c: str = "phone_no") -> Column:
    s = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return (s == "") | (F.char_length(s) != PHONE_LENGTH) | ~s.rlike(NUMERIC_RE)


def email_bad(c: str = "email") -> Column:
    s = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return (s == "") | ~s.rlike(EMAIL_RE)


def employee_errors() -> Column:
    """V2 (employee): name, type, email format, phone 10 numeric characters."""
    return _errors([
        ("Name", _missing_str("name")),
        ("Type", _missing_str("type") | ~F.coalesce(F.col("type").isin(*EMPLOYEE_TYPES), F.lit(False))),
        ("Email", email_bad()),
        ("PhoneNo", phone_bad()),
    ])


def employee_status_bad() -> Column:
    """The stored status is an enum: '' or an unknown value fails on write."""
    return ~F.coalesce(F.col("status").isin(*EMPLOYEE_STATUSES), F.lit(False))


def user_errors() -> Column:
    """V2 (user): name, email format, phone 10 numeric characters, password length >= 6."""
    pw = F.coalesce(F.col("password").cast("string"), F.lit(""))
    return _errors([
        ("Name", _missing_str("name")),
        ("Email", email_bad()),
        ("PhoneNo", phone_bad()),
        ("Password", (pw == "") | (F.char_length(pw) < PASSWORD_MIN)),
    ])


def user_type_bad(c: str = "user_type") -> Column:
    return ~F.coalesce(F.col(c).isin(*USER_TYPES), F.lit(False))


def reassign_errors() -> Column:
    """V3 (reassign): all five fields required."""
    return _errors([
        ("AssetID", _missing_str("asset_id")),
        ("EmployeeID", _missing_str("employee_id")),
        ("RetrievedDate", _missing("retrieved_date")),
        ("RetrievalReason", _missing_str("retrieval_reason")),
        ("AssignedDate", _missing_str("assigned_date")),
    ])


def delete_errors() -> Column:
    """V3 (delete asset): id and type required."""
    return _errors([("ID", _missing_str("id")), ("AssetType", _missing_str("asset_type"))])


def error_message(errors: Column) -> Column:
    """V4: "Invalid <last failing field>", NULL when valid."""
    return F.when(F.size(errors) > 0, F.concat(F.lit("Invalid "), F.element_at(errors, -1)))


def validate(df: DataFrame, errors: Column) -> DataFrame:
    """Add ``errors`` (array) and ``message`` columns to every request row."""
    return df.withColumn("errors", errors).withColumn("message", error_message(F.col("errors")))
