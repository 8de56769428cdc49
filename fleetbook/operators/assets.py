"""Asset reports: lists, specifications, pickers, histories and open counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.functions.filters import ListFilter
from fleetbook.functions.predicates import all_of, contains_ci, warranty_predicate
from fleetbook.plans.joins import left_join_many
from fleetbook.plans.paging import check_page, find_page, select_places, stored_keys
from fleetbook.sources.schemas import SPEC_COLUMNS
from fleetbook.sources.tables import Tables

LIST_COLUMNS = ["id", "brand", "model", "serial_no", "asset_type", "purchased_date", "status",
                "warranty_expiry_date", "assigned_to_id", "name"]
EXPORT_COLUMNS = LIST_COLUMNS[:8]
SPEC_COMMON = ["brand", "model", "serial_no", "asset_type", "purchased_date", "status",
               "warranty_expiry_date", "archived_at", "archive_reason", "deleted_by",
               "owned_by", "client_name"]


def _asset_filters(flt: ListFilter, as_of: dt.datetime) -> list[Column]:
    """Type, brand and warranty predicates; absent parameters add nothing."""
    preds = []
    if flt.asset_types:
        preds.append(F.col("asset_type").isin(*flt.asset_types))
    if flt.name:
        preds.append(contains_ci("brand", flt.name))
    preds.append(warranty_predicate("warranty_expiry_date", flt.warranty, flt.is_expired, as_of))
    return [p for p in preds if p is not None]


# --------------------------------------------------------------------------- R1


def current_holders(t: Tables) -> DataFrame:
    """Per asset with relations: the holder picked by the list, and how many rows survive.

    Row choice = open relation first, then the latest retrieved date, then the lowest relation
    id, among relations whose employee is not archived (a missing employee counts as not
    archived).  ``min_by`` is a partial aggregate, so an asset with a huge history is reduced
    on the map side before the shuffle; no window over a hot partition.
    """
    rel = t.relation.select(F.col("id").alias("rel_id"), "asset_id", "employee_id",
                            "retrieved_date")
    emp = t.employee.select(F.col("id").alias("e_id"), F.col("name").alias("e_name"),
                            F.col("archived_at").alias("e_archived_at"))
    joined = rel.join(emp, rel["employee_id"] == emp["e_id"], "left")
    passes = F.col("e_archived_at").isNull()
    # min over (closed, -day, relation id, holder): the struct order is the row choice.
    ranked = F.when(passes, F.struct(
        F.col("retrieved_date").isNotNull().alias("closed"),
        (-F.unix_date("retrieved_date")).alias("neg_day"),
        F.col("rel_id"), F.col("e_id"), F.col("e_name")))
    return joined.groupBy("asset_id").agg(
        F.min(ranked).alias("holder"), F.count_if(passes).alias("n_visible"))


def asset_list_rows(t: Tables, flt: ListFilter, as_of: dt.datetime) -> DataFrame:
    """Unpaged rows of the plain asset list: live assets, one row each, with holder."""
    a = t.assets.filter(all_of([F.col("archived_at").isNull(), *_asset_filters(flt, as_of)]))
    h = current_holders(t)
    j = a.join(h, a["id"] == h["asset_id"], "left")
    # The employee filter sits after the outer join: an asset whose every relation points at
    # an archived employee disappears; a never-assigned asset stays.
    j = j.filter(F.col("asset_id").isNull() | (F.col("n_visible") > 0))
    held = F.col("is_available") == F.lit(False)
    return j.select(
        *EXPORT_COLUMNS[:6], "status", "warranty_expiry_date",
        F.when(held, F.col("holder.e_id")).alias("assigned_to_id"),
        F.when(held, F.col("holder.e_name")).otherwise(F.lit("")).alias("name"))


def visibility(t: Tables) -> DataFrame:
    """Per asset with relations: how many, and how many point at a non-archived employee."""
    rel = t.relation.select("asset_id", "employee_id")
    emp = t.employee.select(F.col("id").alias("e_id"), F.col("archived_at").alias("e_archived_at"))
    return (rel.join(emp, rel["employee_id"] == emp["e_id"], "left")
            .groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_rel"),
                                     F.count_if(F.col("e_archived_at").isNull()).alias("n_visible")))


def asset_list(t: Tables, flt: ListFilter, as_of: dt.datetime) -> DataFrame:
    """Page of live assets with their current holder and the total (``pagination`` ignored).

    Which assets are listed needs only per-asset counts (a hash aggregate), computed once and stored
    as bare ids while the page is looked for.  The rows are then those of the unpaged list over the
    page's range of asset ids, which the scans of both tables are given.
    """
    check_page(flt.limit, flt.page)
    a = t.assets.filter(all_of([F.col("archived_at").isNull(), *_asset_filters(flt, as_of)])).select("id")
    v = visibility(t)
    listed = (a.join(v, a["id"] == v["asset_id"], "left")
              .filter(F.col("asset_id").isNull() | (F.col("n_visible") > 0)).select("id"))
    with stored_keys(listed) as keys:
        page = find_page(keys, "id", flt.offset, flt.limit)
    few = t.with_(assets=page.of(t.assets, "id"), relation=page.of(t.relation, "asset_id"))
    return asset_list_rows(few, flt, as_of).select(page.total_column(), *LIST_COLUMNS)


# --------------------------------------------------------------------------- R2, R3


def status_predicate(flt: ListFilter, as_of: dt.datetime, strict: bool = False) -> Column:
    """Status flags OR-ed, other filters AND-ed.

    Faithful (default): the filters bind only to the *last* enabled flag, because AND binds
    tighter than OR in the generated text.  ``strict=True`` parenthesises the flags.
    """
    arms = [F.col("status") == F.lit(s) for s, on in
            (("available", flt.available), ("assigned", flt.assigned), ("deleted", flt.deleted))
            if on]
    if not arms:
        raise ValueError("the status list needs at least one of available/assigned/deleted")
    extra = _asset_filters(flt, as_of)
    if strict:
        flags = arms[0]
        for a in arms[1:]:
            flags = flags | a
        return all_of([flags, *extra])
    pred = all_of([arms[-1], *extra])
    for a in reversed(arms[:-1]):
        pred = a | pred
    return pred


def asset_status_rows(t: Tables, flt: ListFilter, as_of: dt.datetime, strict: bool = False) -> DataFrame:
    """Unpaged rows of the status list: one row per relation ever (no "current" filter)."""
    a = t.assets.filter(status_predicate(flt, as_of, strict)).select(
        "id", "brand", "model", "serial_no", "asset_type", "purchased_date", "status", "warranty_expiry_date")
    rel = t.relation.select(F.col("id").alias("rel_id"), F.col("asset_id").alias("rel_asset"),
                            "employee_id")
    ar = left_join_many(a, rel, "id", "rel_asset")
    emp = t.employee.select(F.col("id").alias("e_id"), F.col("name").alias("e_name"))
    are = ar.join(emp, ar["employee_id"] == emp["e_id"], "left")
    return are.select(
        *EXPORT_COLUMNS, "rel_id",
        F.when(F.col("status") == "assigned", F.col("e_id")).alias("assigned_to_id"),
        F.when(F.col("status").isin("assigned", "deleted"), F.col("e_name"))
         .otherwise(F.lit("")).alias("name"))


def asset_list_by_status(t: Tables, flt: ListFilter, as_of: dt.datetime,
                         strict: bool = False) -> DataFrame:
    """R2 (and R3 when ``flt.pagination`` is false).

    Paged: ordered by asset id then relation id (the stored query orders by id only; the
    relation id makes pages deterministic).  Unpaged: 8 columns, no order, no limit.
    """
    if not flt.pagination:
        return asset_status_rows(t, flt, as_of, strict).select(*EXPORT_COLUMNS)
    check_page(flt.limit, flt.page)
    a = t.assets.filter(status_predicate(flt, as_of, strict)).select("id")
    # one row per listed asset with its number of result rows, max(1, its relations)
    per_asset = t.relation.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_rel"))
    weighed = (a.join(per_asset, F.col("id") == F.col("asset_id"), "left")
               .select("id", F.coalesce("n_rel", F.lit(1)).alias("n_rel")))
    with stored_keys(weighed) as keys:
        page = find_page(keys, "id", flt.offset, flt.limit, F.col("n_rel"))
    few = t.with_(assets=page.of(t.assets, "id"), relation=page.of(t.relation, "asset_id"))
    rows = asset_status_rows(few, flt, as_of, strict)
    # assets that lie partly in the page: the relations that are its first and last
    cuts = {}
    if page.skip:
        cuts[page.first, "first"] = (page.skip, page.first_rows)
    if page.spare:
        cuts[page.last, "last"] = (page.last_rows - page.spare - 1, page.last_rows)
    for (asset, side), (index, n_rel) in cuts.items():
        _, place = select_places(t.relation.filter(F.col("asset_id") == F.lit(asset)), "id", [index], known=n_rel)
        edge = F.col("rel_id") >= F.lit(place[index].key) if side == "first" else F.col("rel_id") <= F.lit(place[index].key)
        rows = rows.filter((F.col("id") != F.lit(asset)) | edge)
    return rows.select(page.total_column(), *LIST_COLUMNS)


def asset_export(t: Tables, flt: ListFilter, as_of: dt.datetime, strict: bool = False) -> DataFrame:
    """The status list without pagination (every matching row, 8 columns)."""
    return asset_status_rows(t, flt, as_of, strict).select(*EXPORT_COLUMNS)


# --------------------------------------------------------------------------- R4, R5


def _specs(t: Tables, asset_type: str, ids: DataFrame | None, first_flag: bool) -> DataFrame:
    a = restrict(t.assets, "id", ids)
    common = [F.col("a.id").alias("asset_id")] + [F.col(f"a.{c}").alias(c) for c in SPEC_COMMON]
    if asset_type == "mouse":
        extra = [F.lit(True).alias("__first")] if first_flag else []
        return a.alias("a").select(*common, *extra)
    spec = t.spec(asset_type)
    if spec is None:
        raise ValueError(f"unknown asset type {asset_type!r}")
    fam = [F.col(f"s.{c}").alias(c) for c in SPEC_COLUMNS[asset_type]]
    j = a.alias("a").join(spec.alias("s"), F.col("a.id") == F.col("s.asset_id"), "inner")
    if not first_flag:
        return j.select(*common, *fam)
    first = (restrict(spec, "asset_id", ids).groupBy("asset_id")
             .agg(F.min("id").alias("first_spec_id")).alias("f"))
    j = j.join(first, F.col("s.asset_id") == F.col("f.asset_id"), "inner")
    return j.select(*common, *fam, (F.col("s.id") == F.col("f.first_spec_id")).alias("__first"))


def asset_specs(t: Tables, asset_type: str, ids: DataFrame | None = None) -> DataFrame:
    """Common columns plus the family columns of ``asset_type`` (the caller's type).

    Families join inner (the stored query filters on the spec side); archived spec rows are
    included.  Mouse has no family table: every asset (of any type) with common columns.
    ``ids`` (first column = asset id) restricts to those assets; ``None`` answers all.
    """
    return _specs(t, asset_type, ids, first_flag=False)


FAMILY_PREFIX = {"laptop": "laptop", "pen drive": "pen_drive", "hard disk": "hard_disk",
                 "mobile": "mobile", "sim": "sim"}


def all_specs(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """R4 (wide): every asset with the columns of all five families, prefixed by family.

    Five left joins on the asset id; each family table has one row per asset, so the joins
    add columns, not rows (an asset with several rows in a family gets one row per row).
    """
    out = restrict(t.assets, "id", ids).select(F.col("id").alias("asset_id"), *SPEC_COMMON)
    for family, prefix in FAMILY_PREFIX.items():
        spec = t.spec(family).select(F.col("asset_id").alias(f"__{prefix}"),
                                     *[F.col(c).alias(f"{prefix}_{c}") for c in SPEC_COLUMNS[family]])
        out = out.join(spec, F.col("asset_id") == F.col(f"__{prefix}"), "left").drop(f"__{prefix}")
    return out


def asset_detail(t: Tables, asset_type: str, ids: DataFrame | None = None) -> DataFrame:
    """R4 with the assignee history attached to the first spec row of each asset.

    Flat form: one row per history entry on the first spec row (lowest spec id), columns
    prefixed ``h_``; other spec rows and assets without history carry NULL history columns.
    The history is never collected into one array, so an asset with a huge history does not
    become one oversized row or task.
    """
    base = _specs(t, asset_type, ids, first_flag=True)
    hist = assignee_history(t, ids).select(
        F.col("asset_id").alias("h_asset_id"), *[F.col(c).alias(f"h_{c}") for c in HISTORY_COLUMNS])
    cols = ["asset_id", *SPEC_COMMON, *SPEC_COLUMNS[asset_type], *[f"h_{c}" for c in HISTORY_COLUMNS]]
    # first spec rows take the history (one row -> many: inner join + rows without history,
    # so AQE can split an asset with a huge history); other spec rows carry NULL history
    first = left_join_many(base.filter(F.col("__first")), hist, "asset_id", "h_asset_id")
    rest = base.filter(~F.col("__first"))
    for f in hist.schema.fields:
        rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    return first.select(*cols).unionByName(rest.select(*cols))


# --------------------------------------------------------------------------- R6


def _available(a: DataFrame) -> Column:
    return F.col("a.archived_at").isNull() & (F.col("a.is_available") == F.lit(True))


def available_brands(t: Tables, asset_type: str) -> DataFrame:
    """Distinct brands of live, available assets of a type."""
    return (t.assets.alias("a").filter((F.col("a.asset_type") == asset_type) & _available(t.assets))
            .select("brand").distinct())


def available_models(t: Tables, brand: str, asset_type: str) -> DataFrame:
    """Models of live, available assets of a brand and type (duplicates kept)."""
    return (t.assets.alias("a")
            .filter((F.col("a.brand") == brand) & (F.col("a.asset_type") == asset_type)
                    & _available(t.assets))
            .select("model"))


def available_units(t: Tables, brand: str, model: str) -> DataFrame:
    """Id and serial number of live, available assets of a brand and model (any type)."""
    return (t.assets.alias("a")
            .filter((F.col("a.brand") == brand) & (F.col("a.model") == model) & _available(t.assets))
            .select("id", "serial_no"))


def _with_spec(t: Tables, family: str, cond: Column, col: str) -> DataFrame:
    spec = t.spec(family).select("asset_id", col, F.col("archived_at").alias("s_archived_at"))
    j = t.assets.alias("a").filter(cond & _available(t.assets)).join(
        spec.alias("s"), F.col("a.id") == F.col("s.asset_id"), "left")
    # the spec filter after the outer join keeps assets without a spec row
    return j.filter(F.col("s_archived_at").isNull()).select(F.col("a.id").alias("id"), col)


def available_mobiles(t: Tables, brand: str, model: str) -> DataFrame:
    """R6d: id, imei_1 of live, available assets of a brand and model; the type is not checked."""
    return _with_spec(t, "mobile", (F.col("a.brand") == brand) & (F.col("a.model") == model),
                      "imei_1")


def available_sims(t: Tables, brand: str) -> DataFrame:
    """R6e: id, sim_no of live, available assets of a brand; type and model are not checked."""
    return _with_spec(t, "sim", F.col("a.brand") == brand, "sim_no")


def available_picker(t: Tables, brand: str = "", asset_type: str = "", model: str = "") -> DataFrame:
    """Dispatcher of the availability picker over (brand, type, model)."""
    if asset_type and not brand:
        return available_brands(t, asset_type)
    if brand:
        if asset_type == "sim":
            return available_sims(t, brand)
        if model == "":
            return available_models(t, brand, asset_type)
        if asset_type == "mobile":
            return available_mobiles(t, brand, model)
        return available_units(t, brand, model)
    raise ValueError("the picker needs a brand or an asset type")


# --------------------------------------------------------------------------- R7, R8

HISTORY_COLUMNS = ["id", "name", "email", "phone_no", "assigned_by", "assigned_date",
                   "retrieved_date", "retrieval_reason"]
ASSET_HISTORY_COLUMNS = ["id", "brand", "model", "serial_no", "asset_type", "assigned_date",
                         "retrieved_date", "retrieval_reason"]


def restrict(df: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    if ids is None:
        return df
    k = ids.select(F.col(ids.columns[0]).alias("__k")).distinct()
    return df.join(k, df[key] == k["__k"], "left_semi")


def assignee_history(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Employees (not archived) who held each asset, with the relation dates."""
    rel = restrict(t.relation, "asset_id", ids)
    e = t.employee.filter(F.col("archived_at").isNull())
    j = rel.alias("r").join(e.alias("e"), F.col("e.id") == F.col("r.employee_id"), "inner")
    return j.select(
        F.col("r.asset_id").alias("asset_id"), F.col("e.id").alias("id"), "e.name", "e.email",
        "e.phone_no", "r.assigned_by", "r.assigned_date", "r.retrieved_date",
        F.coalesce(F.col("r.retrieval_reason"), F.lit("")).alias("retrieval_reason"))


def asset_history(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Live assets each employee held; ``ids=None`` answers every employee."""
    rel = restrict(t.relation, "employee_id", ids)
    a = t.assets.filter(F.col("archived_at").isNull())
    j = rel.alias("r").join(a.alias("a"), F.col("r.asset_id") == F.col("a.id"), "inner")
    return j.select(
        F.col("r.employee_id").alias("employee_id"), F.col("a.id").alias("id"), "a.brand",
        "a.model", "a.serial_no", "a.asset_type", "r.assigned_date", "r.retrieved_date",
        F.coalesce(F.col("r.retrieval_reason"), F.lit("")).alias("retrieval_reason"))


# --------------------------------------------------------------------------- R16


def open_relations(t: Tables) -> DataFrame:
    """Relations still open for the guards: not retrieved and not archived."""
    return t.relation.filter(F.col("retrieved_date").isNull() & F.col("archived_at").isNull())


def open_counts_by_asset(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Per asset, the number of open relations (0 when none); partial aggregation."""
    counts = (restrict(open_relations(t), "asset_id", ids)
              .groupBy("asset_id").agg(F.count(F.lit(1)).alias("open_count")))
    a = restrict(t.assets.select(F.col("id").alias("asset_id")), "asset_id", ids)
    return (a.join(counts, "asset_id", "left")
            .select("asset_id", F.coalesce("open_count", F.lit(0).cast("bigint")).alias("open_count")))
