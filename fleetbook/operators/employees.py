"""Employee reports: list with asset quantities, detail with history, open counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.functions.filters import ListFilter
from fleetbook.functions.predicates import contains_ci
from fleetbook.operators.assets import asset_history, open_relations, restrict
from fleetbook.plans.joins import left_join_many
from fleetbook.plans.paging import Page, check_page, find_page, stored_keys
from fleetbook.sources.tables import Tables

EMPLOYEE_COLUMNS = ["id", "name", "email", "phone_no", "status", "type", "archived_at",
                    "archive_reason", "deleted_by"]
LIST_COLUMNS = EMPLOYEE_COLUMNS + ["asset_quantity"]


def relation_counts_by_type(t: Tables) -> DataFrame:
    """Relations per (employee, asset type); type NULL when the asset row is missing.

    Partial aggregation reduces a hot employee before the shuffle; the result has at most
    one row per employee and type.
    """
    rel = t.relation.select("employee_id", "asset_id")
    a = t.assets.select(F.col("id").alias("a_id"), "asset_type")
    return (rel.join(a, rel["asset_id"] == a["a_id"], "left")
            .groupBy("employee_id", "asset_type").agg(F.count(F.lit(1)).alias("n")))


def employee_predicate(flt: ListFilter, strict: bool = False) -> Column:
    """Row predicate over (employee columns, asset_type) with the stored-query precedence.

    ``term_empty OR (name matches AND id_empty) OR id_equal``: an id given with an empty term
    filters nothing.  Archived employees are visible when an id or the deleted flag is given.
    Both status flags: ``(filters AND status='deleted') OR status='not_an_employee'`` unless
    ``strict``, where the filters apply to both statuses.
    """
    eid = flt.employee_id
    visible = F.lit(True) if (eid != "" or flt.deleted) else F.col("archived_at").isNull()
    if flt.asset_types:
        typed = F.coalesce(F.col("asset_type").isin(*flt.asset_types), F.lit(False))
    else:
        typed = F.lit(True)
    id_equal = F.col("id").cast("string") == F.lit(eid)
    if flt.name == "":
        search = F.lit(True)
    else:
        name_hit = contains_ci("name", flt.name) & F.lit(eid == "")
        search = F.coalesce(name_hit, F.lit(False)) | id_equal
    base = visible & typed & search
    st = F.col("status")
    if flt.deleted and not flt.not_an_employee:
        return base & (st == "deleted")
    if flt.not_an_employee and not flt.deleted:
        return base & (st == "not_an_employee")
    if flt.deleted and flt.not_an_employee:
        if strict:
            return base & st.isin("deleted", "not_an_employee")
        return (base & (st == "deleted")) | (st == "not_an_employee")
    return base & (st == "active")


def employee_rows(t: Tables, flt: ListFilter, strict: bool = False) -> DataFrame:
    """Unpaged employee list rows with ``asset_quantity`` (relations ever, matching rows only)."""
    c = relation_counts_by_type(t)
    e = t.employee.select(*EMPLOYEE_COLUMNS)
    j = e.join(c, e["id"] == c["employee_id"], "left")
    j = j.filter(F.coalesce(employee_predicate(flt, strict), F.lit(False)))
    return (j.groupBy(*EMPLOYEE_COLUMNS)
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("asset_quantity")))


def employee_list(t: Tables, flt: ListFilter, strict: bool = False) -> DataFrame:
    """A page of employees with asset quantities and the total (ordered by id)."""
    return _employee_page(t, flt, strict)[1]


def _employee_page(t: Tables, flt: ListFilter, strict: bool) -> tuple[Page, DataFrame]:
    """Where the page lies, and its rows.

    Without an asset-type filter the predicate reads employee columns only, so the page is found in
    the employee table alone, and relations are counted just for its range of employees.  A
    type filter reads the relations of every employee, so the listed ids are stored while the page
    is looked for.
    """
    check_page(flt.limit, flt.page)
    if flt.asset_types:
        with stored_keys(employee_rows(t, flt, strict).select("id")) as keys:
            page = find_page(keys, "id", flt.offset, flt.limit)
        few = t.with_(employee=page.of(t.employee, "id"), relation=page.of(t.relation, "employee_id"))
        rows = employee_rows(few, flt, strict)
    else:
        listed = t.employee.select(*EMPLOYEE_COLUMNS).filter(F.coalesce(employee_predicate(flt, strict), F.lit(False)))
        page = find_page(listed, "id", flt.offset, flt.limit)
        counts = page.of(t.relation, "employee_id").groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))
        rows = (page.of(listed, "id").join(counts, F.col("id") == F.col("employee_id"), "left")
                .withColumn("asset_quantity", F.coalesce("n", F.lit(0)).cast("bigint")))
    return page, rows.select(page.total_column(), *LIST_COLUMNS)


def employee_detail(t: Tables, flt: ListFilter, employee_id: str = "",
                    ids: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Employee rows with their asset history, flat (one row per history entry, ``h_``).

    Faithful (default): the list page computed with ``employee_id``; the history of that
    employee is attached to the first row of the page, whichever employee it is.  With
    ``strict=True`` and ``ids`` (first column = employee id): each listed employee matching
    an id, with its own history.
    """
    hist_cols = ["id", "brand", "model", "serial_no", "asset_type", "assigned_date",
                 "retrieved_date", "retrieval_reason"]
    if strict:
        if ids is None:
            raise ValueError("strict detail needs ids")
        t = t.with_(employee=restrict(t.employee, "id", ids), relation=restrict(t.relation, "employee_id", ids))
        rows = employee_rows(t, flt, strict=True)
        hist = asset_history(t)
        h = hist.select(F.col("employee_id").alias("h_owner"),
                        *[F.col(c).alias(f"h_{c}") for c in hist_cols])
        out = left_join_many(rows, h, "id", "h_owner")
        return out.select(*LIST_COLUMNS, *[f"h_{c}" for c in hist_cols])
    f = ListFilter(**{**flt.__dict__, "employee_id": employee_id})
    page, rows = _employee_page(t, f, strict=False)
    if page.first is None:
        return rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in _history_types(t, hist_cols)])
    rel = t.relation
    if employee_id != "":
        rel = rel.filter(F.col("employee_id").cast("string") == F.lit(employee_id))
    h = asset_history(t.with_(relation=rel)).select("employee_id", *[F.col(c).alias(f"h_{c}") for c in hist_cols])
    # every history row goes to the page's first row, whose columns are one scalar: no join at all
    columns = rows.columns
    first = rows.filter(F.col("id") == F.lit(page.first)).agg(F.first(F.struct(*columns)).alias("first"))
    given = (h.withColumn("__first", first.scalar())
             .select(*[F.col(f"__first.{c}").alias(c) for c in columns], *[f"h_{c}" for c in hist_cols]))
    found = h.limit(1).agg(F.count(F.lit(1))).scalar()
    rest = rows.filter((F.col("id") != F.lit(page.first)) | (found == 0))
    rest = rest.select("*", *[F.lit(None).cast(k).alias(c) for c, k in _history_types(t, hist_cols)])
    return given.unionByName(rest)


def _history_types(t: Tables, columns: list[str]) -> list[tuple[str, T.DataType]]:
    schema = asset_history(t).schema
    return [(f"h_{c}", schema[c].dataType) for c in columns]


def open_counts_by_employee(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Per employee, the number of open relations (0 when none)."""
    counts = (restrict(open_relations(t), "employee_id", ids)
              .groupBy("employee_id").agg(F.count(F.lit(1)).alias("open_count")))
    e = restrict(t.employee.select(F.col("id").alias("employee_id")), "employee_id", ids)
    return (e.join(counts, "employee_id", "left")
            .select("employee_id",
                    F.coalesce("open_count", F.lit(0).cast("bigint")).alias("open_count")))
