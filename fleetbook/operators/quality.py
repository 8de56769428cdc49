"""Integrity audit of the declared constraints (Q1).

Spark enforces none of the stored schema's constraints, so this report checks them over the
whole tables: NOT NULL, non-empty e-mail, unique e-mail, unique phone among live users, enum
domains and foreign keys.  One row per (table, rule) with the number of violations.

Per table, the row-local rules and the foreign keys are one pass (left joins to the parents'
distinct ids, then ``count_if`` per rule and ``stack``); uniqueness is a grouped count.
Every piece is a global or keyed aggregate: nothing reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.sources.schemas import (ASSET_STATUSES, ASSET_TYPES, EMPLOYEE_STATUSES,
                                       EMPLOYEE_TYPES, OWNED_BY, USER_STATUSES, USER_TYPES)
from fleetbook.sources.tables import Tables


def _outside(col: str, domain) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).isin(*domain)


def _row_rules(df: DataFrame, table: str, rules: list[tuple[str, Column]]) -> DataFrame:
    agg = df.agg(*[F.count_if(pred).alias(f"r{i}") for i, (_, pred) in enumerate(rules)])
    pairs = ", ".join(f"'{name}', r{i}" for i, (name, _) in enumerate(rules))
    return agg.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)").select(
        F.lit(table).alias("table_name"), "rule", F.col("violations").cast("bigint"))


def _unique(df: DataFrame, table: str, col: str, rule: str) -> DataFrame:
    dup = df.filter(F.col(col).isNotNull()).groupBy(col).count().filter(F.col("count") > 1)
    return dup.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations")


def _checked(child: DataFrame, table: str, rules: list[tuple[str, Column]],
             fks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Row rules and foreign keys of one table in a single pass over it.

    Each foreign key is a left join to the parent's distinct ids (one row per id, so no row
    multiplies); an orphan is a non-NULL key without a parent.  All rules are then counted by
    one aggregate.
    """
    df, preds = child, list(rules)
    for i, (col, parent, rule) in enumerate(fks):
        keys = parent.select(F.col("id").alias(f"__pk{i}")).distinct()
        df = df.join(keys, df[col] == keys[f"__pk{i}"], "left")
        preds.append((rule, F.col(col).isNotNull() & F.col(f"__pk{i}").isNull()))
    return _row_rules(df, table, preds)


def integrity_report(t: Tables) -> DataFrame:
    """Q1: violations per declared constraint, one row per (table_name, rule)."""
    nn = lambda c: F.col(c).isNull()
    parts = [
        _checked(t.users, "users", [
            ("name not null", nn("name")), ("email not null", nn("email")),
            ("phone_no not null", nn("phone_no")), ("password not null", nn("password")),
            ("email not empty", F.col("email") == ""),
            ("type in domain", _outside("type", USER_TYPES)),
            ("status in domain", _outside("status", USER_STATUSES))], []),
        _unique(t.users, "users", "email", "email unique"),
        _unique(t.users.filter(F.col("archived_at").isNull()), "users", "phone_no",
                "live phone_no unique"),
        _checked(t.employee, "employee", [
            ("name not null", nn("name")), ("email not null", nn("email")),
            ("phone_no not null", nn("phone_no")), ("email not empty", F.col("email") == ""),
            ("status in domain", _outside("status", EMPLOYEE_STATUSES)),
            ("type in domain", _outside("type", EMPLOYEE_TYPES))],
            [("deleted_by", t.users, "deleted_by references users")]),
        _unique(t.employee, "employee", "email", "email unique"),
        _checked(t.assets, "assets", [
            ("brand not null", nn("brand")), ("model not null", nn("model")),
            ("serial_no not null", nn("serial_no")), ("asset_type not null", nn("asset_type")),
            ("purchased_date not null", nn("purchased_date")),
            ("warranty_start_date not null", nn("warranty_start_date")),
            ("warranty_expiry_date not null", nn("warranty_expiry_date")),
            ("created_by not null", nn("created_by")),
            ("asset_type in domain", _outside("asset_type", ASSET_TYPES)),
            ("status in domain", _outside("status", ASSET_STATUSES)),
            ("owned_by in domain", _outside("owned_by", OWNED_BY))],
            [("created_by", t.users, "created_by references users"),
             ("deleted_by", t.users, "deleted_by references users")]),
        _checked(t.relation, "employee_asset_relation", [
            ("employee_id not null", nn("employee_id")), ("asset_id not null", nn("asset_id")),
            ("assigned_date not null", nn("assigned_date"))],
            [("employee_id", t.employee, "employee_id references employee"),
             ("asset_id", t.assets, "asset_id references assets"),
             ("assigned_by", t.users, "assigned_by references users")]),
        _checked(t.sessions, "sessions", [("user_id not null", nn("user_id"))], [("user_id", t.users, "user_id references users")]),
    ]
    for name, spec in (("laptop_specifications", t.laptop), ("pen_drive_specifications", t.pen_drive),
                       ("hard_disk_specifications", t.hard_disk),
                       ("mobile_specifications", t.mobile), ("sim_specifications", t.sim)):
        needed = ["asset_id", "storage"] if name in ("pen_drive_specifications", "hard_disk_specifications") else ["asset_id"]
        parts.append(_checked(spec, name, [(f"{c} not null", nn(c)) for c in needed],
                              [("asset_id", t.assets, "asset_id references assets")]))
    for name, df in t.by_name().items():
        parts.append(_unique(df, name, "id", "id unique"))
    return reduce(DataFrame.unionByName, parts)
