"""Asset write operators over request batches.

A request frame has one row per request with ``seq`` (unique, ascending = arrival order),
``req_ts`` (the request's "now") and ``actor_id`` (the signed-in user) plus the body fields.
A NULL body field is an absent JSON field and takes the Go zero value ('' / 0001-01-01 /
false) where the stored statement would write it.  Every operator returns
``Changes(tables, rejects)`` equal to applying the requests one by one in ``seq`` order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.operators.assets import open_counts_by_asset
from fleetbook.operators.validate import (asset_create_errors, asset_update_errors, delete_errors,
                                          error_message, reassign_errors)
from fleetbook.plans.batch import (ZERO_DATE, Changes, chain_next, matched_update, new_id,
                                   split_by_reason, winners)
from fleetbook.sources.schemas import SPEC_COLUMNS
from fleetbook.sources.tables import SPEC_ATTR, TABLE_TO_ATTR, Tables, conform

SPEC_UPDATED_AT = {"laptop": True, "mobile": True, "sim": True, "pen drive": False, "hard disk": False}


def _zs(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _zd(c: str):
    return F.coalesce(F.col(c).cast("date"), F.lit(ZERO_DATE).cast("date"))


def _id_type(t: Tables):
    return t.assets.schema["id"].dataType


def _validation_reason(errors):
    return F.when(F.size(errors) > 0, error_message(errors))


def _known(table: DataFrame, req: DataFrame, col: str, alias: str) -> DataFrame:
    """The table's ids that the batch mentions: the batch's distinct keys (small) semi-join
    the id column, so the big table is filtered where it is read instead of shuffled whole."""
    wanted = req.select(F.col(col).alias(alias)).distinct()
    return table.select(F.col("id").alias(alias)).join(wanted, alias, "left_semi")


def _fk_reason(req: DataFrame, t: Tables, emp_col: str | None, asset_col: str | None):
    """Requests left-joined to the employee/asset key sets; reason when a key is unknown."""
    out = req
    reason = F.lit(None).cast("string")
    if emp_col:
        keys = _known(t.employee, req, emp_col, "__fk_e")
        out = out.join(keys, out[emp_col] == keys["__fk_e"], "left")
        reason = F.when(F.col("__fk_e").isNull(), F.lit("unknown employee"))
    if asset_col:               # last, so that the rows stay dealt by asset for what follows
        keys = _known(t.assets, req, asset_col, "__fk_a")
        out = out.join(keys, out[asset_col] == keys["__fk_a"], "left")
        reason = F.when(F.col("__fk_a").isNull(), F.lit("unknown asset")).otherwise(reason)
    return out, reason


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


# --------------------------------------------------------------------------- W8


def set_availability(assets: DataFrame, requests: DataFrame) -> DataFrame:
    """``is_available``/``status`` of live assets; last request per asset wins.

    ``requests``: seq, asset_id, available (bool).
    """
    w = winners(requests.select("seq", "asset_id", "available"), ["asset_id"], last=True)
    return matched_update(
        assets, w, [("id", "asset_id")],
        {"is_available": F.col("r_available"),
         "status": F.when(F.col("r_available"), F.lit("available")).otherwise(F.lit("assigned"))},
        guard=assets["archived_at"].isNull())


# --------------------------------------------------------------------------- W1


def register_assets(t: Tables, requests: DataFrame) -> Changes:
    """Insert assets (available, status 'available') and their family spec rows.

    ``owned_by = 'remote_state'`` blanks the client name.  Invalid requests are rejected
    with the validation message.  Every accepted request inserts (append-all).
    """
    ok, rejects = split_by_reason(requests, _validation_reason(asset_create_errors()))
    idt = _id_type(t)
    ok = ok.withColumn("__new_id", new_id("register_asset", "seq", idt))
    new_assets = ok.select(
        F.col("__new_id").alias("id"), _zs("brand").alias("brand"), _zs("model").alias("model"),
        _zs("serial_no").alias("serial_no"), F.col("asset_type"),
        F.col("purchased_date").cast("date").alias("purchased_date"),
        F.col("warranty_start_date").cast("date").alias("warranty_start_date"),
        F.col("warranty_expiry_date").cast("date").alias("warranty_expiry_date"),
        F.col("actor_id").alias("created_by"), F.col("req_ts").alias("created_at"),
        F.lit(True).alias("is_available"), F.col("owned_by"),
        F.when(F.col("owned_by") == "remote_state", F.lit("")).otherwise(_zs("client_name"))
         .alias("client_name"),
        F.lit("available").alias("status"))
    added = {"assets": conform(new_assets, t.assets.schema)}
    for family, attr in SPEC_ATTR.items():
        target = getattr(t, attr)
        cols = [(F.coalesce(F.col(c), F.lit(False)) if c == "charger" else _zs(c)).alias(c)
                for c in SPEC_COLUMNS[family]]
        rows = ok.filter(F.col("asset_type") == family).select(
            new_id("register_spec", "seq", idt).alias("id"), F.col("__new_id").alias("asset_id"),
            *cols, F.col("req_ts").alias("created_at"))
        added[table_name(attr)] = conform(rows, target.schema)
    return Changes({name: getattr(t, TABLE_TO_ATTR[name]).unionByName(rows) for name, rows in added.items()}, rejects, added)


def table_name(attr: str) -> str:
    from fleetbook.sources.tables import ATTR_TO_TABLE
    return ATTR_TO_TABLE[attr]


# --------------------------------------------------------------------------- W2, W3


def update_assets(t: Tables, requests: DataFrame) -> Changes:
    """Live asset columns (last request per asset), then the spec table of each request's
    type (last request per asset and type), guarded by the spec row being live.

    Hard disk and pen drive spec updates leave ``updated_at`` untouched.
    """
    ok, rejects = split_by_reason(requests, _validation_reason(asset_update_errors()))
    w = winners(ok, ["id"], last=True)
    assets = matched_update(
        t.assets, w, [("id", "id")],
        {"brand": F.col("r_brand"), "model": F.coalesce("r_model", F.lit("")),
         "serial_no": F.coalesce("r_serial_no", F.lit("")),
         "purchased_date": F.col("r_purchased_date"),
         "warranty_start_date": F.coalesce("r_warranty_start_date", F.lit(ZERO_DATE).cast("date")),
         "warranty_expiry_date": F.coalesce("r_warranty_expiry_date", F.lit(ZERO_DATE).cast("date")),
         "updated_at": F.col("r_req_ts")},
        guard=t.assets["archived_at"].isNull())
    changed = {"assets": assets}
    for family, attr in SPEC_ATTR.items():
        target = getattr(t, attr)
        fw = winners(ok.filter(F.col("asset_type") == family), ["id"], last=True)
        sets = {c: (F.coalesce(F.col("r_" + c), F.lit(False)) if c == "charger"
                    else F.coalesce(F.col("r_" + c).cast("string"), F.lit("")))
                for c in SPEC_COLUMNS[family]}
        if SPEC_UPDATED_AT[family]:
            sets["updated_at"] = F.col("r_req_ts")
        changed[table_name(attr)] = matched_update(target, fw, [("asset_id", "id")], sets,
                                                   guard=target["archived_at"].isNull())
    return Changes(changed, rejects)


def update_warranty(t: Tables, requests: DataFrame) -> Changes:
    """Warranty dates of live assets, last request per asset; ``updated_at`` untouched."""
    w = winners(requests.select("seq", "asset_id", "warranty_start_date", "warranty_expiry_date"),
                ["asset_id"], last=True)
    assets = matched_update(
        t.assets, w, [("id", "asset_id")],
        {"warranty_start_date": F.coalesce("r_warranty_start_date", F.lit(ZERO_DATE).cast("date")),
         "warranty_expiry_date": F.coalesce("r_warranty_expiry_date", F.lit(ZERO_DATE).cast("date"))},
        guard=t.assets["archived_at"].isNull())
    return Changes({"assets": assets}, requests.sparkSession.createDataFrame([], "seq long, reason string"))


# --------------------------------------------------------------------------- W4, W5, W6


def _new_relations(ok: DataFrame, op: str, idt, assigned_date, closing: dict | None = None) -> DataFrame:
    closing = closing or {}
    return ok.select(
        new_id(op, "seq", idt).alias("id"), F.col("employee_id"), F.col("asset_id"),
        F.col("actor_id").alias("assigned_by"), assigned_date.alias("assigned_date"),
        closing.get("retrieved_date", F.lit(None).cast("date")).alias("retrieved_date"),
        closing.get("retrieval_reason", F.lit(None).cast("string")).alias("retrieval_reason"),
        F.col("req_ts").alias("created_at"),
        closing.get("archived_at", F.lit(None).cast("timestamp")).alias("archived_at"))


def assign_assets(t: Tables, requests: DataFrame) -> Changes:
    """Insert a relation per request and mark live assets assigned.

    Nothing else is checked (double assignment and archived assets are accepted); an unknown
    employee or asset fails the statement, so that request is rejected as a whole.
    """
    joined, reason = _fk_reason(requests, t, "employee_id", "asset_id")
    ok, rejects = split_by_reason(joined, reason)
    ok = _drop_helpers(ok)
    rel = t.relation.unionByName(conform(
        _new_relations(ok, "assign", _id_type(t), _zd("assigned_date")), t.relation.schema))
    assets = set_availability(t.assets, ok.select("seq", "asset_id", F.lit(False).alias("available")))
    return Changes({"employee_asset_relation": rel, "assets": assets}, rejects)


def reassign_assets(t: Tables, requests: DataFrame) -> Changes:
    """Per request, close every unarchived relation of the asset (retrieved ones too),
    mark the asset assigned and insert the new relation.

    Batch form: the first request of an asset closes the stored relations; the relation
    inserted by each request is closed by the asset's next request (``lead`` over seq); the
    last one stays open.  ``assigned_date`` arrives as text: unparsable -> rejected, as are
    validation failures and unknown keys (the transaction rolls back, closing nothing).
    """
    v = requests.withColumn("__ad", F.try_to_date(F.col("assigned_date").cast("string")))
    v_reason = F.coalesce(_validation_reason(reassign_errors()),
                          F.when(F.col("__ad").isNull(), F.lit("Invalid AssignedDate")))
    ok, rej1 = split_by_reason(v, v_reason)
    joined, fk = _fk_reason(ok, t, "employee_id", "asset_id")
    ok, rej2 = split_by_reason(joined, fk)
    ok = _drop_helpers(ok.withColumnRenamed("__ad", "parsed_assigned_date"))
    first = winners(ok.select("seq", "asset_id", "retrieved_date", "retrieval_reason", "req_ts"),
                    ["asset_id"], last=False)
    # archived relations stay as they are: they need not be dealt out for the join
    live = t.relation.filter(F.col("archived_at").isNull())
    closed = matched_update(
        live, first, [("asset_id", "asset_id")],
        {"retrieved_date": F.col("r_retrieved_date"), "retrieval_reason": F.col("r_retrieval_reason"),
         "archived_at": F.col("r_req_ts")}).unionByName(t.relation.filter(F.col("archived_at").isNotNull()))
    # Requests of one asset are applied in seq order: each closes its predecessor's relation.
    chained = chain_next(ok, "asset_id", "seq", ["retrieved_date", "retrieval_reason", "req_ts"])
    new_rows = _new_relations(chained, "reassign", _id_type(t), F.col("parsed_assigned_date"), {
        "retrieved_date": F.col("__next.retrieved_date").cast("date"),
        "retrieval_reason": F.col("__next.retrieval_reason"),
        "archived_at": F.col("__next.req_ts")})
    rel = closed.unionByName(conform(new_rows, t.relation.schema))
    assets = set_availability(t.assets, ok.select("seq", "asset_id", F.lit(False).alias("available")))
    return Changes({"employee_asset_relation": rel, "assets": assets}, rej1.unionByName(rej2))


def retrieve_assets(t: Tables, requests: DataFrame) -> Changes:
    """Close the (employee, asset) relations not yet retrieved; the first request per pair
    does it, later ones match nothing.  Every request marks the asset available, even when no
    relation matched."""
    first = winners(requests.select("seq", "employee_id", "asset_id", "retrieved_date",
                                    "retrieval_reason"), ["employee_id", "asset_id"], last=False)
    rel = matched_update(
        t.relation, first, [("employee_id", "employee_id"), ("asset_id", "asset_id")],
        {"retrieved_date": F.coalesce(F.col("r_retrieved_date").cast("date"),
                                      F.lit(ZERO_DATE).cast("date")),
         "retrieval_reason": F.coalesce(F.col("r_retrieval_reason"), F.lit(""))},
        guard=t.relation["retrieved_date"].isNull())
    assets = set_availability(t.assets, requests.select("seq", "asset_id",
                                                        F.lit(True).alias("available")))
    return Changes({"employee_asset_relation": rel, "assets": assets},
                   requests.sparkSession.createDataFrame([], "seq long, reason string"))


# --------------------------------------------------------------------------- W7


def delete_assets(t: Tables, requests: DataFrame) -> Changes:
    """Soft-delete assets that nobody holds, and archive the spec row of the request's type.

    Guard (read before the batch; relations are not modified): an open, unarchived relation
    rejects the request.  First request per asset archives it; spec rows first per (asset,
    type), so a later request naming another type still archives that family's row.
    """
    ok, rej1 = split_by_reason(requests, _validation_reason(delete_errors()))
    counts = open_counts_by_asset(t, ok.select("id")).withColumnRenamed("asset_id", "__gid")
    guarded = ok.join(counts, ok["id"] == counts["__gid"], "left")
    ok, rej2 = split_by_reason(
        guarded, F.when(F.coalesce(F.col("open_count"), F.lit(0)) > 0, F.lit("asset is assigned")))
    ok = _drop_helpers(ok).drop("open_count")
    first = winners(ok.select("seq", "id", "req_ts", "actor_id", "delete_reason"), ["id"], last=False)
    assets = matched_update(
        t.assets, first, [("id", "id")],
        {"archived_at": F.col("r_req_ts"), "status": F.lit("deleted"),
         "archive_reason": F.coalesce(F.col("r_delete_reason"), F.lit("")),
         "deleted_by": F.col("r_actor_id")},
        guard=t.assets["archived_at"].isNull())
    changed = {"assets": assets}
    for family, attr in SPEC_ATTR.items():
        target = getattr(t, attr)
        fw = winners(ok.filter(F.col("asset_type") == family).select("seq", "id", "req_ts"),
                     ["id"], last=False)
        changed[table_name(attr)] = matched_update(target, fw, [("asset_id", "id")],
                                                   {"archived_at": F.col("r_req_ts")},
                                                   guard=target["archived_at"].isNull())
    return Changes(changed, rej1.unionByName(rej2))
