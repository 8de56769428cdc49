"""Registered validation, integrity and stream queries with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetbook.catalog_reads import ORACLE, QUERIES, URL_SQL
from fleetbook.catalog_writes import (ATTEMPT_SQL, COMPANY_DOMAIN, DELETE_REQ, REASSIGN_REQ,
                                      REGISTER_REQ, REGISTER_USER_REQ, REL_COLS, UPSERT_REQ,
                                      SESSION_COLS, WARRANTY_REQ, _bind, _ctes, _req)
from fleetbook.functions.filters import query_param
from fleetbook.functions.predicates import to_flag
from fleetbook.operators import asset_writes as aw
from fleetbook.operators import validate as v
from fleetbook.operators.quality import integrity_report
from fleetbook.plans.session import ensure_checkpoint_dir
from fleetbook.sources.fixtures import duckdb_ctes, read_source, shared_tables
from fleetbook.sources.requests import write_requests
from fleetbook.sources.tables import ADDED_TABLES, load_tables, write_snapshot
from fleetbook.streaming.login_stream import OUTCOMES, login_policy_stream
from fleetbook.streaming.request_stream import apply_request_stream, current_tables, emitted


def T(spark, sf):
    return shared_tables(spark, sf)


# --------------------------------------------------------------------------- Q1

def _oracle_integrity() -> str:
    def rows(table, rules):
        return [f"select '{table}' as table_name, '{name}' as rule, "
                f"count(*) filter (where {pred}) as violations from {table}" for name, pred in rules]

    def dom(c, values):
        return f"{c} is not null and {c} not in ({', '.join(repr(x) for x in values)})"

    def uniq(table, col, rule, where="true"):
        return (f"select '{table}', '{rule}', count(*) from (select {col} from {table} "
                f"where {col} is not null and {where} group by {col} having count(*) > 1) d")

    def fk(table, col, parent, rule, src=None):
        src = src or table
        return (f"select '{table}', '{rule}', count(*) from {src} c where c.{col} is not null "
                f"and not exists (select 1 from {parent} p where p.id = c.{col})")

    parts = rows("users", [("name not null", "name is null"), ("email not null", "email is null"),
                           ("phone_no not null", "phone_no is null"),
                           ("email not empty", "email = ''"),
                           ("type in domain", dom("type", ["authorized", "unauthorized", "blocked"])),
                           ("status in domain", dom("status", ["white_listed", "black_listed", "warned"]))])
    parts += [f"select 'users', 'password not null', count(*) from users",
              f"select 'assets', 'created_by not null', count(*) from assets",
              "select 'sessions', 'user_id not null', count(*) from sessions where user_id is null"]
    parts += [uniq(name, "id", "id unique") for name in ("users", "employee", "assets", "employee_asset_relation", "sessions")]
    parts += [f"select '{s}', 'asset_id not null', count(*) from {s} where asset_id is null" for s in (
        "laptop_specifications", "pen_drive_specifications", "hard_disk_specifications",
        "mobile_specifications", "sim_specifications")]
    parts += [f"select '{s}', 'storage not null', count(*) from {s} where storage is null" for s in (
        "pen_drive_specifications", "hard_disk_specifications")]
    parts += [f"select '{s}', 'id unique', 0" for s in (
        "laptop_specifications", "pen_drive_specifications", "hard_disk_specifications",
        "mobile_specifications", "sim_specifications")]
    parts += [uniq("users", "email", "email unique"),
              uniq("users", "phone_no", "live phone_no unique", "archived_at is null")]
    parts += rows("employee", [("name not null", "name is null"), ("email not null", "email is null"),
                               ("phone_no not null", "phone_no is null"),
                               ("email not empty", "email = ''"),
                               ("status in domain", dom("status", ["active", "deleted", "not_an_employee"])),
                               ("type in domain", dom("type", ["employee", "intern", "freelancer"]))])
    parts += [uniq("employee", "email", "email unique"),
              fk("employee", "deleted_by", "users", "deleted_by references users")]
    parts += rows("assets", [(f"{c} not null", f"{c} is null") for c in
                             ("brand", "model", "serial_no", "asset_type", "purchased_date",
                              "warranty_start_date", "warranty_expiry_date")]
                  + [("asset_type in domain", dom("asset_type", ["laptop", "mouse", "pen drive",
                                                                 "hard disk", "mobile", "sim"])),
                     ("status in domain", dom("status", ["available", "assigned", "deleted"])),
                     ("owned_by in domain", dom("owned_by", ["remote_state", "client"]))])
    parts += [fk("assets", "created_by", "users", "created_by references users",
                 "(select cast(null as bigint) as created_by from assets)"),
              fk("assets", "deleted_by", "users", "deleted_by references users")]
    parts += rows("employee_asset_relation", [("employee_id not null", "employee_id is null"),
                                              ("asset_id not null", "asset_id is null"),
                                              ("assigned_date not null", "assigned_date is null")])
    parts += [fk("employee_asset_relation", "employee_id", "employee", "employee_id references employee"),
              fk("employee_asset_relation", "asset_id", "assets", "asset_id references assets"),
              fk("employee_asset_relation", "assigned_by", "users", "assigned_by references users"),
              fk("sessions", "user_id", "users", "user_id references users")]
    for spec in ("laptop_specifications", "pen_drive_specifications", "hard_disk_specifications",
                 "mobile_specifications", "sim_specifications"):
        parts.append(fk(spec, "asset_id", "assets", "asset_id references assets"))
    needs = ["users", "employee", "assets", "employee_asset_relation", "sessions",
             "laptop_specifications", "pen_drive_specifications", "hard_disk_specifications",
             "mobile_specifications", "sim_specifications"]
    return duckdb_ctes(needs) + "\nunion all\n".join(parts)


QUERIES["q01_integrity_report"] = lambda s, sf: integrity_report(T(s, sf))
ORACLE["q01_integrity_report"] = _oracle_integrity()

# --------------------------------------------------------------------------- V1-V4


def _validated(req_sql, errors):
    def run(spark, sf):
        t = T(spark, sf)
        out = v.validate(_req(spark, t, req_sql), errors())
        return out.select("seq", F.array_join("errors", ",").alias("errors"), "message")
    return run


def _oracle_validation(req_sql, needs, rules):
    items = ", ".join(f"case when {pred} then '{name}' end" for name, pred in rules)
    last = " ".join(f"when {pred} then 'Invalid {name}'" for name, pred in reversed(rules))
    return (_ctes(needs, {"req": _bind(req_sql)})
            + f"select seq, concat_ws(',', {items}) as errors, case {last} end as message from req")


_TYPES = "('laptop', 'mouse', 'pen drive', 'hard disk', 'mobile', 'sim')"
_EMAIL_BAD = "(coalesce(email, '') = '' or not regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'))"
_PHONE_BAD = ("(coalesce(phone_no, '') = '' or length(phone_no) <> 10 "
              "or not regexp_matches(phone_no, '^[-+]?[0-9]+(\\.[0-9]+)?$'))")
QUERIES["v01_validate_asset_requests"] = _validated(REGISTER_REQ, v.asset_create_errors)
ORACLE["v01_validate_asset_requests"] = _oracle_validation(REGISTER_REQ, ["assets"], [
    ("Brand", "coalesce(brand, '') = ''"),
    ("AssetType", f"coalesce(asset_type, '') = '' or asset_type not in {_TYPES}"),
    ("PurchasedDate", "purchased_date is null"), ("WarrantyStartDate", "warranty_start_date is null"),
    ("WarrantyExpiryDate", "warranty_expiry_date is null"),
    ("OwnedBy", "coalesce(owned_by in ('remote_state', 'client'), false) = false")])
QUERIES["v02_validate_employee_requests"] = _validated(UPSERT_REQ, v.employee_errors)
ORACLE["v02_validate_employee_requests"] = _oracle_validation(UPSERT_REQ, ["employee"], [
    ("Name", "coalesce(name, '') = ''"),
    ("Type", "coalesce(type, '') = '' or type not in ('employee', 'intern', 'freelancer')"),
    ("Email", _EMAIL_BAD), ("PhoneNo", _PHONE_BAD)])
QUERIES["v02_validate_user_requests"] = _validated(REGISTER_USER_REQ, v.user_errors)
ORACLE["v02_validate_user_requests"] = _oracle_validation(REGISTER_USER_REQ, ["users"], [
    ("Name", "coalesce(name, '') = ''"), ("Email", _EMAIL_BAD), ("PhoneNo", _PHONE_BAD),
    ("Password", "coalesce(password, '') = '' or length(password) < 6")])
QUERIES["v03_validate_reassign_requests"] = _validated(REASSIGN_REQ, v.reassign_errors)
ORACLE["v03_validate_reassign_requests"] = _oracle_validation(
    REASSIGN_REQ, ["employee_asset_relation"], [
        ("AssetID", "asset_id is null"), ("EmployeeID", "employee_id is null"),
        ("RetrievedDate", "retrieved_date is null"),
        ("RetrievalReason", "coalesce(retrieval_reason, '') = ''"),
        ("AssignedDate", "coalesce(assigned_date, '') = ''")])
QUERIES["v03_validate_delete_requests"] = _validated(DELETE_REQ, v.delete_errors)
ORACLE["v03_validate_delete_requests"] = _oracle_validation(DELETE_REQ, ["assets"], [
    ("ID", "id is null"), ("AssetType", "coalesce(asset_type, '') = ''")])

# --------------------------------------------------------------------------- F2


def _f02(spark, sf):
    pages = read_source(spark, sf, "pages").selectExpr("page_id", f"{URL_SQL} as request_url")
    raw = query_param(F.col("request_url"), "available")
    return pages.select("page_id", to_flag(raw).alias("available"))


QUERIES["f02_to_flag"] = _f02
ORACLE["f02_to_flag"] = (
    f"with u as (select page_id, {URL_SQL} as request_url from pages), "
    "q as (select page_id, case when instr(request_url, '?') > 0 and (instr(request_url, '#') = 0 "
    "or instr(request_url, '?') < instr(request_url, '#')) then regexp_extract(request_url, "
    "'\\?([^#]*)', 1) else '' end as q from u) "
    "select page_id, coalesce(regexp_extract(q, '(^|&)available=([^&]*)', 2) in "
    "('true', 'TRUE', 'True'), false) as available from q")

# --------------------------------------------------------------------------- S1, S2


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetbook-{uuid.uuid4().hex}"


def _s01(spark, sf):
    root = _scratch(spark)
    write_snapshot(T(spark, sf), f"{root}/base")
    t = load_tables(spark, f"{root}/base")
    req = _req(spark, t, REASSIGN_REQ)
    # first moves arrive before second moves: each wave of files is one micro-batch
    for k in (1, 2):
        write_requests(req.filter(F.col("seq") % 10 == k), f"{root}/requests", "reassign_assets", mode="append")
        apply_request_stream(spark, "reassign_assets", aw.reassign_assets, f"{root}/requests", f"{root}/base",
                             f"{root}/out", f"{root}/checkpoint", max_files_per_trigger=1000, buckets=8).awaitTermination()
    return current_tables(spark, f"{root}/base", f"{root}/out").relation.select(*REL_COLS)


def _s01_two(spark, sf):
    """Two operations in turn on one set of tables; both streams count their epochs from 0."""
    root = _scratch(spark)
    write_snapshot(T(spark, sf), f"{root}/base")
    t = load_tables(spark, f"{root}/base")
    for op, sql, run in (("update_warranty", WARRANTY_REQ, aw.update_warranty),
                         ("reassign_assets", REASSIGN_REQ, aw.reassign_assets)):
        write_requests(_req(spark, t, sql), f"{root}/{op}", op)
        apply_request_stream(spark, op, run, f"{root}/{op}", f"{root}/base", f"{root}/out", f"{root}/checkpoint-{op}",
                             max_files_per_trigger=1000, buckets=8).awaitTermination()
    now = current_tables(spark, f"{root}/base", f"{root}/out")
    dates = now.assets.select(F.col("id").alias("of"), "warranty_start_date", "warranty_expiry_date", "status")
    rel = now.relation.select(*REL_COLS)
    return rel.join(dates, rel["asset_id"] == dates["of"], "left").drop("of")


QUERIES["s01_two_operations_stream"] = _s01_two
ORACLE["s01_two_operations_stream"] = (
    "select r.*, w.warranty_start_date, w.warranty_expiry_date, a.status from (" + ORACLE["w05_reassign_relations"]
    + ") r left join (" + ORACLE["w03_update_warranty"] + ") w on w.id = r.asset_id left join ("
    + ORACLE["w05_reassign_assets"] + ") a on a.id = r.asset_id")
QUERIES["s01_reassign_stream"] = _s01
ORACLE["s01_reassign_stream"] = ORACLE["w05_reassign_relations"]


def _s02(spark, sf):
    """All attempts in three waves of files, one micro-batch each; returns the stream's root."""
    root = _scratch(spark)
    write_snapshot(T(spark, sf), f"{root}/base")
    attempts = spark.sql(ATTEMPT_SQL, events=read_source(spark, sf, "events"))
    top = attempts.agg(F.max("seq")).first()[0]  # one scalar: where to cut the waves
    for k in range(3):
        part = attempts.filter((F.col("seq") * 3 / (top + 1)).cast("int") == k)
        write_requests(part, f"{root}/attempts", "login_attempts", mode="append")
        login_policy_stream(spark, f"{root}/attempts", f"{root}/base", f"{root}/out", f"{root}/checkpoint", COMPANY_DOMAIN,
                            max_files_per_trigger=1000, buckets=8).awaitTermination()
    return root


def _s02_outcomes(spark, sf):
    return emitted(spark, f"{_s02(spark, sf)}/out", OUTCOMES).select("seq", "email", "outcome")


def _s02_users(spark, sf):
    root = _s02(spark, sf)
    return current_tables(spark, f"{root}/base", f"{root}/out").users.select("id", "type", "status", "authentication_times")


def _s02_sessions(spark, sf):
    root = _s02(spark, sf)
    return current_tables(spark, f"{root}/base", f"{root}/out").sessions.select(*SESSION_COLS)


QUERIES["s02_login_policy_stream"] = _s02_outcomes
ORACLE["s02_login_policy_stream"] = ORACLE["w16_login_outcomes"]
QUERIES["s02_login_users"] = _s02_users
ORACLE["s02_login_users"] = ORACLE["w16_login_users"]
QUERIES["s02_login_sessions"] = _s02_sessions
ORACLE["s02_login_sessions"] = ORACLE["w16_login_sessions"]

# --------------------------------------------------------------------------- sources and sinks

from fleetbook.catalog_reads import oracle_access  # noqa: E402
from fleetbook.operators import access  # noqa: E402
from fleetbook.sources.requests import read_requests  # noqa: E402
from fleetbook.sources.sinks import append_rows, append_to_table, read_appended, read_report, write_report  # noqa: E402

_REL_FULL = ["id", "employee_id", "asset_id", "assigned_by", "assigned_date", "retrieved_date",
             "retrieval_reason", "archived_at"]


def _x01(spark, sf):
    root = _scratch(spark)
    write_snapshot(T(spark, sf), f"{root}/v1")
    return load_tables(spark, f"{root}/v1").relation.select(*_REL_FULL)


QUERIES["x01_snapshot_round_trip"] = _x01
ORACLE["x01_snapshot_round_trip"] = (duckdb_ctes(["employee_asset_relation"])
                                     + "select " + ", ".join(_REL_FULL) + " from employee_asset_relation")



def _x04(spark, sf):
    """A snapshot in the first schema version: no later columns, no tables of later families."""
    root = _scratch(spark)
    t = T(spark, sf)
    old = {"users": t.users.drop("type", "authentication_times", "status", "image"),
           "employee": t.employee.drop("status", "type", "archive_reason", "deleted_by"),
           "assets": t.assets.drop("is_available", "owned_by", "client_name", "status", "deleted_by", "archive_reason")}
    whole = t.by_name()
    write_snapshot({n: old.get(n, whole[n]) for n in whole if n not in ADDED_TABLES}, f"{root}/v1")
    u = load_tables(spark, f"{root}/v1")
    none = F.lit(None)
    assert u.mobile.schema.names == t.mobile.schema.names
    return (u.assets.select(F.lit("assets").alias("kind"), "id", "brand", "status", "is_available", none.cast("string").alias("type"), none.cast("int").alias("times"))
            .unionByName(u.users.select(F.lit("users").alias("kind"), "id", F.col("name").alias("brand"), "status", none.cast("boolean").alias("is_available"),
                                        "type", F.col("authentication_times").alias("times")))
            .unionByName(u.employee.select(F.lit("employee").alias("kind"), "id", F.col("name").alias("brand"), "status", none.cast("boolean").alias("is_available"),
                                           "type", none.cast("int").alias("times"))))


QUERIES["x04_old_snapshot"] = _x04
ORACLE["x04_old_snapshot"] = (duckdb_ctes(["assets", "users", "employee"])
                              + "select 'assets' as kind, id, brand, 'available' as status, true as is_available, cast(null as varchar) as type, "
                              "cast(null as integer) as times from assets "
                              "union all select 'users', id, name, 'white_listed', null, 'authorized', null from users "
                              "union all select 'employee', id, name, 'active', null, null, null from employee")

_REQ_COLS = ["seq", "req_ts", "actor_id", "asset_id", "employee_id", "retrieved_date",
             "retrieval_reason", "assigned_date"]


def _x02(spark, sf):
    root = _scratch(spark)
    write_requests(_req(spark, T(spark, sf), REASSIGN_REQ), f"{root}/requests", "reassign_assets")
    good, _bad = read_requests(spark, f"{root}/requests", "reassign_assets")
    return good.select(*_REQ_COLS)


QUERIES["x02_request_files_round_trip"] = _x02
ORACLE["x02_request_files_round_trip"] = (_ctes(["employee_asset_relation"], {"req": _bind(REASSIGN_REQ)})
                                          + "select " + ", ".join(_REQ_COLS) + " from req")


def _x03(spark, sf):
    root = _scratch(spark)
    write_report(access.access_report(T(spark, sf), "authorized"), f"{root}/report")
    schema = ("id long, name string, email string, authenticationTimes int, status string, "
              "lastLoginTime timestamp")
    return read_report(spark, f"{root}/report", schema)


QUERIES["x03_report_round_trip"] = _x03
ORACLE["x03_report_round_trip"] = (
    "select id, name, email, authentication_times as \"authenticationTimes\", status, "
    "start_time as \"lastLoginTime\" from (" + duckdb_ctes(["users", "sessions"])
    + oracle_access("authorized", "") + ") q")

# Sign-up events become new sessions of their user (append of derived rows)
SIGNUP_SQL = """
select event_id + 1000000000 as id, user_id % 10 as user_id, cast(ts as timestamp) as start_time
from {events} where event_type = 'signup'"""


def _w18(spark, sf):
    rows_ = spark.sql(SIGNUP_SQL, events=read_source(spark, sf, "events"))
    return append_rows(T(spark, sf).sessions, rows_).select("id", "user_id", "start_time", "end_time")


def _w18_stored(spark, sf):
    """The sessions as batch 0, the sign-ups as two batches, one of them appended twice."""
    sessions, path = T(spark, sf).sessions, f"{ensure_checkpoint_dir(spark).rstrip('/')}/w18-{uuid.uuid4().hex}"
    rows_ = append_rows(sessions.limit(0), spark.sql(SIGNUP_SQL, events=read_source(spark, sf, "events")))
    append_to_table(sessions, path, 0)
    for batch in (1, 2, 1):
        append_to_table(rows_.filter(F.col("id") % 2 == batch - 1), path, batch)
    return read_appended(spark, path, sessions.schema).select("id", "user_id", "start_time", "end_time")


QUERIES["w18_append_rows"] = _w18
ORACLE["w18_append_rows"] = (duckdb_ctes(["sessions"]) + "select id, user_id, start_time, end_time from sessions "
                             "union all select id, user_id, start_time, cast(null as timestamp) from ("
                             + SIGNUP_SQL.replace("{events}", "events") + ") s")
QUERIES["w18_append_to_table"] = _w18_stored
ORACLE["w18_append_to_table"] = ORACLE["w18_append_rows"]
