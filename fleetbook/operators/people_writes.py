"""Employee and user write operators over request batches.

Unique e-mail / phone columns: a request is rejected if another row holds the value when its turn
comes, be it stored or written by an earlier accepted request; values that earlier requests of the batch
freed can be taken (``plans.claims``).  The result equals the one-by-one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.operators.employees import open_counts_by_employee
from fleetbook.plans.joins import mentioned
from fleetbook.operators.validate import (employee_errors, employee_status_bad, error_message,
                                          user_errors, user_type_bad)
from fleetbook.plans.batch import Changes, matched_update, new_id, split_by_reason, winners
from fleetbook.plans.claims import claims_of, holders, refusals
from fleetbook.plans.session import cut_lineage
from fleetbook.sources.tables import Tables, conform


def _vreason(errors):
    return F.when(F.size(errors) > 0, error_message(errors))


def _empty_rejects(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "seq long, reason string")


def _open_guard(t: Tables, req: DataFrame, emp_col: str, applies=None):
    counts = open_counts_by_employee(t, req.select(emp_col)).withColumnRenamed("employee_id", "__gid")
    j = req.join(counts, req[emp_col] == counts["__gid"], "left")
    busy = F.coalesce(F.col("open_count"), F.lit(0)) > 0
    if applies is not None:
        busy = busy & applies
    return j, busy


def _as_kind(requests: DataFrame, kind: str, column: str) -> DataFrame:
    return requests.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"))


def _with_refusals(requests: DataFrame, refused: DataFrame, kinds: list[str]) -> DataFrame:
    """``requests`` plus ``__taken_<kind>``: another row holds the value."""
    flags = refused.groupBy(F.col("seq").alias("__rseq")).agg(*[F.max(F.col("kind") == k).alias(f"__taken_{k}") for k in kinds])
    out = requests.join(flags, F.col("seq") == F.col("__rseq"), "left").drop("__rseq")
    return out.withColumns({f"__taken_{k}": F.coalesce(f"__taken_{k}", F.lit(False)) for k in kinds})


def _updates_in_turn(requests: DataFrame, table: DataFrame, held: dict) -> DataFrame:
    """The requests whose target row exists and is not archived (the others change nothing, so they
    neither take nor free a value) plus ``__taken_<kind>``.  One pass over ``table`` finds live
    targets and the holders of all values asked for."""
    requests = cut_lineage(requests)
    kinds = list(held)
    wanted = claims_of(requests, F.col("id"), kinds).select("kind", "value").unionByName(_as_kind(requests, "id", "id"))
    found = holders(table, {**held, "id": "case when archived_at is null then id end"}, wanted)
    live = found.filter("kind = 'id'").select(F.col("value").alias("__live"))
    base = requests.join(live, F.col("id").cast("string") == F.col("__live"), "left_semi")
    return _with_refusals(base, refusals(claims_of(base, F.col("id"), kinds), found.filter("kind <> 'id'")), kinds)


#: Who holds a unique value: any user an e-mail, a live user a phone; any employee an e-mail.
USER_HOLDS = {"email": "email", "phone_no": "case when archived_at is null then phone_no end"}
EMPLOYEE_HOLDS = {"email": "email"}


def _password_reason():
    """The hash arrives with the request; the password itself is only validated."""
    return F.coalesce(_vreason(user_errors()), F.when(F.coalesce("password_hash", F.lit("")) == "", F.lit("Invalid PasswordHash")))


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__") or c == "open_count"])


# --------------------------------------------------------------------------- W9-W11


def upsert_employees(t: Tables, requests: DataFrame) -> Changes:
    """Insert employees; an e-mail that already exists (any state) leaves the row unchanged.

    Within the batch the first request per new e-mail inserts; later ones hit the conflict.
    """
    ok, rejects = split_by_reason(requests, _vreason(employee_errors()))
    known = mentioned(t.employee, "email", ok, "email").select(F.col("email").alias("__e"))
    fresh = ok.join(known, ok["email"] == known["__e"], "left_anti")
    first = winners(fresh.select("seq", "email", "name", "phone_no", "type", "req_ts"),
                    ["email"], last=False)
    idt = t.employee.schema["id"].dataType
    rows = first.select(new_id("employee", "seq", idt).alias("id"), "name", "email", "phone_no",
                        F.col("req_ts").alias("created_at"), F.lit("active").alias("status"), "type")
    added = conform(rows, t.employee.schema)
    return Changes({"employee": t.employee.unionByName(added)}, rejects, {"employee": added})


def update_employees(t: Tables, requests: DataFrame) -> Changes:
    """Live employee rows take the last accepted request's name, e-mail, phone, status,
    type and ``updated_at``.  Rejected: validation, unknown status, an e-mail that another employee
    holds at that moment, and 'not_an_employee' while holding an asset."""
    reason = F.coalesce(_vreason(employee_errors()),
                        F.when(employee_status_bad(), F.lit("Invalid Status")))
    ok, rej1 = split_by_reason(requests, reason)
    j, busy = _open_guard(t, ok, "id", F.col("status") == "not_an_employee")
    ok, rej2 = split_by_reason(j, F.when(busy, F.lit("asset is assigned to this employee")))
    ok = _updates_in_turn(_clean(ok), t.employee, EMPLOYEE_HOLDS)
    ok, rej3 = split_by_reason(ok, F.when(F.col("__taken_email"), F.lit("email already used")))
    w = winners(_clean(ok).select("seq", "id", "name", "email", "phone_no", "status", "type",
                                  "req_ts"), ["id"], last=True)
    emp = matched_update(t.employee, w, [("id", "id")],
                         {"name": F.col("r_name"), "email": F.col("r_email"),
                          "phone_no": F.col("r_phone_no"), "status": F.col("r_status"),
                          "type": F.col("r_type"), "updated_at": F.col("r_req_ts")},
                         guard=t.employee["archived_at"].isNull())
    return Changes({"employee": emp}, rej1.unionByName(rej2).unionByName(rej3))


def delete_employees(t: Tables, requests: DataFrame) -> Changes:
    """Archive employees holding no open relation (first request per employee wins)."""
    j, busy = _open_guard(t, requests, "employee_id")
    ok, rejects = split_by_reason(j, F.when(busy, F.lit("asset is assigned to this employee")))
    first = winners(_clean(ok).select("seq", "employee_id", "req_ts", "actor_id", "archive_reason"),
                    ["employee_id"], last=False)
    emp = matched_update(t.employee, first, [("id", "employee_id")],
                         {"archived_at": F.col("r_req_ts"),
                          "archive_reason": F.coalesce(F.col("r_archive_reason"), F.lit("")),
                          "deleted_by": F.col("r_actor_id"), "status": F.lit("deleted")},
                         guard=t.employee["archived_at"].isNull())
    return Changes({"employee": emp}, rejects)


# --------------------------------------------------------------------------- W12-W15, W17


def register_users(t: Tables, requests: DataFrame) -> Changes:
    """Insert users (type 'authorized', status 'white_listed', 0 warnings).

    Rejected: validation; a live user with this e-mail AND phone ('user already exists');
    an e-mail that any user or a phone that a live user holds at that moment, users inserted
    by earlier requests included.  ``password_hash`` is stored as it arrives.  Users are read
    once.
    """
    ok, rej1 = split_by_reason(requests, _password_reason())
    base, kinds = cut_lineage(ok), list(USER_HOLDS)
    claims = claims_of(base, F.concat(F.lit("request "), F.col("seq").cast("string")), kinds)
    held = holders(t.users, USER_HOLDS, claims)
    ok = _with_refusals(base, refusals(claims, held), kinds)
    by_phone = held.filter("kind = 'phone_no'").select(F.col("owner").alias("__owner"), F.col("value").alias("__xp"))
    stored = (held.filter("kind = 'email'").join(by_phone, F.col("owner") == F.col("__owner"))
              .select(F.col("value").alias("__xe"), "__xp", F.lit(None).cast("long").alias("__xs")))
    added = ok.filter("not __taken_email and not __taken_phone_no").select(
        F.col("email").alias("__xe"), F.col("phone_no").alias("__xp"), F.col("seq").cast("long").alias("__xs"))
    known = stored.unionByName(added).groupBy("__xe", "__xp").agg(F.min(F.coalesce("__xs", F.lit(-2 ** 63))).alias("__xs"))
    same = (F.col("email") == F.col("__xe")) & (F.col("phone_no") == F.col("__xp")) & (F.col("__xs") < F.col("seq"))
    reason = (F.when(F.col("__xe").isNotNull(), F.lit("user already exists"))
              .when(F.col("__taken_email"), F.lit("email already used"))
              .when(F.col("__taken_phone_no"), F.lit("phone already used")))
    ok, rej2 = split_by_reason(ok.join(known, same, "left"), reason)
    idt = t.users.schema["id"].dataType
    rows = ok.select(new_id("user", "seq", idt).alias("id"), "name", "email", "phone_no",
                     F.col("password_hash").alias("password"), F.col("req_ts").alias("created_at"),
                     F.lit("authorized").alias("type"), F.lit(0).alias("authentication_times"),
                     F.lit("white_listed").alias("status"))
    new = conform(rows, t.users.schema)
    return Changes({"users": t.users.unionByName(new)}, rej1.unionByName(rej2), {"users": new})


def update_users(t: Tables, requests: DataFrame) -> Changes:
    """Live user rows take the last accepted request's name, e-mail, phone, ``password_hash``
    and ``updated_at``.  Rejected: validation, an e-mail that another user or a phone that another
    live user holds at that moment.  Users are read twice: for holders and targets, and for the result."""
    valid, rej1 = split_by_reason(requests, _password_reason())
    ok = _updates_in_turn(valid, t.users, USER_HOLDS)
    reason = (F.when(F.col("__taken_email"), F.lit("email already used"))
              .when(F.col("__taken_phone_no"), F.lit("phone already used")))
    ok, rej2 = split_by_reason(ok, reason)
    w = winners(ok.select("seq", "id", "name", "email", "phone_no", "password_hash", "req_ts"), ["id"], last=True)
    users = matched_update(t.users, w, [("id", "id")],
                           {"name": F.col("r_name"), "email": F.col("r_email"),
                            "phone_no": F.col("r_phone_no"), "password": F.col("r_password_hash"),
                            "updated_at": F.col("r_req_ts")},
                           guard=t.users["archived_at"].isNull())
    return Changes({"users": users}, rej1.unionByName(rej2))


def set_access_type(t: Tables, requests: DataFrame) -> Changes:
    """``users.type`` of live users (last request per user); unknown types rejected."""
    ok, rejects = split_by_reason(requests, F.when(user_type_bad("user_type"), F.lit("invalid user type")))
    w = winners(ok.select("seq", "user_id", "user_type"), ["user_id"], last=True)
    users = matched_update(t.users, w, [("id", "user_id")], {"type": F.col("r_user_type")},
                           guard=t.users["archived_at"].isNull())
    return Changes({"users": users}, rejects)


def set_profile_image(t: Tables, requests: DataFrame) -> Changes:
    """``users.image`` of live users (last request per user)."""
    w = winners(requests.select("seq", "user_id", "url"), ["user_id"], last=True)
    users = matched_update(t.users, w, [("id", "user_id")], {"image": F.col("r_url")},
                           guard=t.users["archived_at"].isNull())
    return Changes({"users": users}, _empty_rejects(requests))


def logout_users(t: Tables, requests: DataFrame) -> Changes:
    """Every session of the user (ended ones too) gets the last logout's time."""
    w = winners(requests.select("seq", "user_id", "req_ts"), ["user_id"], last=True)
    sessions = matched_update(t.sessions, w, [("user_id", "user_id")],
                              {"end_time": F.col("r_req_ts")})
    return Changes({"sessions": sessions}, _empty_rejects(requests))
