"""One log of asset requests of several kinds, applied in ``seq`` order (W3-W7 mixed).

The single-kind operators reduce a batch per key because their requests commute or simply follow each
other; across kinds they do not: a deletion is refused or not depending on the moves before it, a
move after it no longer changes the asset, a retrieval only closes what was opened before.  Every
request is a state transition of its asset, and what each one meets is found by segmented scans
(``plans.scan``), never by a window over all requests of a hot asset:

* an employee's relation with an asset is open or not: assigning opens it, retrieving closes it,
  reassigning the asset closes those of everybody else and opens its own.  So the state that
  a request meets is told by the last request of its (asset, employee), unless a reassignment of the
  asset came later, or by the stored relations if there was neither;
* the number of employees with an open relation is a running sum of the changes since the last
  reassignment, which resets it to one: a deletion is refused where it is not 0;
* an inserted relation is closed by the asset's next reassignment, else by the next retrieval of its
  (asset, employee); stored relations by the first of these;
* the asset takes the last availability and warranty before its first accepted deletion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.operators.assets import open_relations
from fleetbook.operators.asset_writes import _drop_helpers, _fk_reason, _id_type, _new_relations, _validation_reason, table_name
from fleetbook.operators.validate import delete_errors, reassign_errors
from fleetbook.plans.batch import ZERO_DATE, Changes, matched_update, split_by_reason, winners
from fleetbook.plans.joins import mentioned
from fleetbook.plans.session import cut_lineage
from fleetbook.plans.claims import STORED
from fleetbook.plans.scan import WHOLE, WIDTH, first_after, last_before, running_sum
from fleetbook.sources.tables import SPEC_ATTR, Tables, conform

OPERATIONS = ("assign_assets", "reassign_assets", "retrieve_assets", "delete_assets", "update_warranty")


def _zero(column):
    return F.coalesce(column, F.lit(ZERO_DATE).cast("date"))


def checked_log(t: Tables, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that pass their operation's checks, rejects); the guard of deletions comes later."""
    op = F.col("operation")
    ready = log.withColumn("id", F.col("asset_id")).withColumn("__date", F.try_to_date(F.col("assigned_date").cast("string")))
    reason = (F.when(~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), F.lit("unknown operation"))
              .when(op == "reassign_assets", F.coalesce(_validation_reason(reassign_errors()),
                                                        F.when(F.col("__date").isNull(), F.lit("Invalid AssignedDate"))))
              .when(op == "delete_assets", _validation_reason(delete_errors())))
    ok, bad = split_by_reason(ready, reason)
    joined, fk = _fk_reason(ok.withColumnRenamed("__date", "parsed_date"), t, "employee_id", "asset_id")
    ok, unknown = split_by_reason(cut_lineage(joined), F.when(op.isin("assign_assets", "reassign_assets"), fk))
    return _drop_helpers(ok), bad.unionByName(unknown)


def scan_width(log: DataFrame, held: DataFrame) -> int | None:
    """How to scan: assets whole if the largest one, counted with its stored holders, gives no more than WIDTH rows."""
    rows = log.select("asset_id").unionByName(held.select("asset_id"))
    largest = rows.groupBy("asset_id").count().agg(F.max("count")).first()[0] or 0
    return WHOLE if largest <= WIDTH else None


def stored_holders(t: Tables, log: DataFrame) -> DataFrame:
    """(asset_id, employee_id) of the stored open relations of the log's assets, each once."""
    return mentioned(open_relations(t), "asset_id", log, "asset_id").select("asset_id", "employee_id").distinct()


def with_holders(log: DataFrame, held: DataFrame, width: int | None = None) -> DataFrame:
    """``log`` plus ``holders``: how many employees hold the asset when the request arrives.

    What is stored enters as rows before the log that each open a relation, ``WIDTH`` places apart for an
    asset with many of them.  The scans by asset come first: where assets are scanned whole, the rows that are dealt by
    asset then serve the scans by (asset, employee), too.
    """
    place = (F.lit(STORED) + F.pmod(F.xxhash64("employee_id"), F.lit(1 << 20)) * F.lit(WIDTH)).cast("long")
    e = log.withColumns({"__at": F.col("seq").cast("long"), "__held": F.lit(False)})
    e = e.unionByName(held.withColumns({"__at": place, "__held": F.lit(True)}), allowMissingColumns=True)
    op = F.col("operation")
    opens = F.col("__held") | F.coalesce(op.isin("assign_assets", "reassign_assets"), F.lit(False))
    closes, resets = F.coalesce(op == "retrieve_assets", F.lit(False)), F.coalesce(op == "reassign_assets", F.lit(False))
    e = last_before(e, ["asset_id"], "__at", resets, F.struct(F.col("__at").alias("at")), "__reset", width)
    e = last_before(e, ["asset_id", "employee_id"], "__at", opens | closes, F.struct(F.col("__at").alias("at"), opens.alias("opened")), "__own", width)
    later = F.col("__reset").isNull() | (F.col("__own.at") >= F.col("__reset.at"))
    # no request names the holder of a relation without employee
    is_open = F.when(F.col("employee_id").isNotNull() & F.col("__own").isNotNull() & later, F.col("__own.opened")).otherwise(F.lit(False))
    change = F.when(F.col("__held"), 1).when(op == "assign_assets", F.when(is_open, 0).otherwise(1)).when(closes & is_open, -1).otherwise(0)
    e = e.withColumn("__change", change)
    e = running_sum(e, ["asset_id"], "__at", F.col("__change"), "__sum", width)
    e = last_before(e, ["asset_id"], "__at", resets, F.struct(F.col("__sum").alias("sum")), "__since", width)
    before = F.col("__sum") - F.col("__change")
    holders = F.when(F.col("__since").isNotNull(), before - F.col("__since.sum") + 1).otherwise(before)
    return _drop_helpers(e.withColumn("holders", holders).filter(~F.col("__held")))


def _relations(t: Tables, ok: DataFrame, width: int | None) -> DataFrame:
    op = F.col("operation")
    moved = F.struct(F.col("retrieved_date").cast("date").alias("day"), F.col("retrieval_reason").alias("why"),
                     F.col("req_ts").alias("archived"))
    back = F.struct(_zero(F.col("retrieved_date").cast("date")).alias("day"), F.coalesce("retrieval_reason", F.lit("")).alias("why"),
                    F.lit(None).cast("timestamp").alias("archived"))
    # stored relations: the first reassignment of the asset wins over the first retrieval of the pair
    reset = ok.filter(op == "reassign_assets").groupBy(F.col("asset_id").alias("__ra")).agg(F.min_by(moved, F.col("seq")).alias("__r"))
    fetched = ok.filter(op == "retrieve_assets").groupBy(F.col("asset_id").alias("__ta"), F.col("employee_id").alias("__te")).agg(
        F.min_by(back, F.col("seq")).alias("__t"))
    rel = t.relation
    sets = {"retrieved_date": "day", "retrieval_reason": "why", "archived_at": "archived"}

    def closed(rows, by):       # a retrieval leaves archived_at as it was
        return rows.withColumn("__by", by).select(*[F.when(F.col("__by").isNull(), F.col(c)).otherwise(
            F.coalesce(F.col("__by.archived"), F.col(c)) if c == "archived_at" else F.col(f"__by.{sets[c]}")).alias(c) if c in sets
            else F.col(c) for c in rel.columns])

    # a relation that is retrieved is not retrieved again, one that is archived not reassigned: each meets only the join that can change it
    back_then, archived = F.col("retrieved_date").isNotNull(), F.col("archived_at").isNotNull()
    stored = rel.filter(back_then & archived)
    j = rel.filter(back_then & ~archived).join(reset, F.col("asset_id") == F.col("__ra"), "left")
    stored = stored.unionByName(closed(j, F.col("__r")))
    j = rel.filter(~back_then).join(reset, F.col("asset_id") == F.col("__ra"), "left").join(
        fetched, (F.col("asset_id") == F.col("__ta")) & (F.col("employee_id") == F.col("__te")), "left")
    stored = stored.unionByName(closed(j, F.coalesce(F.when(~archived, F.col("__r")), F.col("__t"))))
    # inserted relations: the asset's next reassignment, else the pair's next retrieval
    e = first_after(ok.filter(op != "delete_assets"), ["asset_id"], "seq", op == "reassign_assets", moved, "__r", width)
    e = first_after(e, ["asset_id", "employee_id"], "seq", op == "retrieve_assets", back, "__t", width)
    e = e.withColumn("__by", F.coalesce("__r", "__t"))
    closing = {c: F.col(f"__by.{f}") for c, f in sets.items()}
    idt = _id_type(t)
    for name, day in (("assign", _zero(F.col("parsed_date"))), ("reassign", F.col("parsed_date"))):
        rows = _new_relations(e.filter(op == f"{name}_assets"), name, idt, day, closing)
        stored = stored.unionByName(conform(rows, rel.schema))
    return stored


def _assets(t: Tables, ok: DataFrame, deleted: DataFrame) -> DataFrame:
    op = F.col("operation")
    end = deleted.groupBy(F.col("asset_id").alias("__da")).agg(F.min("seq").alias("__end"))
    e = ok.join(end, F.col("asset_id") == F.col("__da"), "left").filter(F.col("__end").isNull() | (F.col("seq") <= F.col("__end")))
    moves, warranty = op.isin("assign_assets", "reassign_assets", "retrieve_assets"), op == "update_warranty"
    dates = F.struct(_zero(F.col("warranty_start_date")).alias("start"), _zero(F.col("warranty_expiry_date")).alias("expiry"))
    ending = (op == "delete_assets") & (F.col("seq") == F.col("__end"))
    one = e.groupBy("asset_id").agg(
        F.max_by(F.when(moves, op == "retrieve_assets"), F.when(moves, F.col("seq"))).alias("available"),
        F.max_by(F.when(warranty, dates), F.when(warranty, F.col("seq"))).alias("dates"),
        F.max(F.when(ending, F.struct(F.col("req_ts").alias("at"), F.coalesce("delete_reason", F.lit("")).alias("why"),
                                      F.col("actor_id").alias("who")))).alias("gone"))
    a = t.assets
    status = (F.when(F.col("r_gone").isNotNull(), F.lit("deleted")).when(F.col("r_available"), F.lit("available"))
              .when(~F.col("r_available"), F.lit("assigned")).otherwise(a["status"]))
    return matched_update(a, one, [("id", "asset_id")], {
        "is_available": F.coalesce("r_available", a["is_available"]), "status": status,
        "warranty_start_date": F.coalesce("r_dates.start", a["warranty_start_date"]),
        "warranty_expiry_date": F.coalesce("r_dates.expiry", a["warranty_expiry_date"]),
        "archived_at": F.coalesce("r_gone.at", a["archived_at"]), "archive_reason": F.coalesce("r_gone.why", a["archive_reason"]),
        "deleted_by": F.coalesce("r_gone.who", a["deleted_by"])}, guard=a["archived_at"].isNull())


def apply_asset_log(t: Tables, log: DataFrame, width: int | None = None) -> Changes:
    """Apply a mixed log; equal to applying its requests one by one in ``seq`` order.

    ``log``: seq, req_ts, actor_id, operation (one of ``OPERATIONS``), asset_id and the operations' body
    columns: employee_id, assigned_date (text; no date counts as absent when assigning),
    retrieved_date, retrieval_reason, asset_type, delete_reason, warranty_start_date, warranty_expiry_date.
    """
    ok, bad = checked_log(t, log)
    held = stored_holders(t, ok)
    if width is None:
        held = cut_lineage(held)
        width = scan_width(ok, held)
    # the log is read for every table it changes: what each request meets is found once and written
    ok = cut_lineage(with_holders(ok, held, width))
    busy = (F.col("operation") == "delete_assets") & (F.col("holders") > 0)
    ok, refused = split_by_reason(ok, F.when(busy, F.lit("asset is assigned")))
    deleted = ok.filter(F.col("operation") == "delete_assets")
    changed = {"employee_asset_relation": _relations(t, ok, width), "assets": _assets(t, ok, deleted)}
    for family, attr in SPEC_ATTR.items():
        target = getattr(t, attr)
        first = winners(deleted.filter(F.col("asset_type") == family).select("seq", "asset_id", "req_ts"), ["asset_id"], last=False)
        changed[table_name(attr)] = matched_update(target, first, [("asset_id", "asset_id")], {"archived_at": F.col("r_req_ts")},
                                                   guard=target["archived_at"].isNull())
    return Changes(changed, bad.unionByName(refused))
