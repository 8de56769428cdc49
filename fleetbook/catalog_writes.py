"""Registered write queries: request batches derived by rule from the whole fixture tables,
the operator's resulting table, and an oracle computing that table in SQL.

Request SQL runs unchanged on Spark (``{table}`` bound to a DataFrame) and on DuckDB (bound to
the fixture CTE).  Generated ids and columns holding them are left out of compared columns.
The oracle expresses each rule with windows over the requests (``row_number``, ``lead``): an
independent formulation of the one-by-one semantics.
"""

from __future__ import annotations

from fleetbook.catalog_reads import ORACLE, QUERIES
from fleetbook.operators import asset_writes as aw
from fleetbook.operators import login as lg
from fleetbook.operators import people_writes as pw
from fleetbook.operators.asset_log import apply_asset_log
from fleetbook.sources.fixtures import duckdb_ctes, shared_tables
from fleetbook.sources.tables import TABLE_TO_ATTR

COMPANY_DOMAIN = "example.com"
REQ_TS = "cast(date '1997-06-15' + cast({s} % 50 as int) as timestamp)"

# Columns present in the fixture views (others are NULL in both engines).
FIXTURE_COLS = {
    "assets": {"id", "brand", "model", "serial_no", "asset_type", "purchased_date",
               "warranty_start_date", "warranty_expiry_date", "status", "is_available", "owned_by",
               "client_name", "archived_at", "archive_reason", "deleted_by"},
    "employee_asset_relation": {"id", "employee_id", "asset_id", "assigned_by", "assigned_date",
                                "retrieved_date", "retrieval_reason", "archived_at"},
    "employee": {"id", "name", "email", "phone_no", "status", "type", "archived_at",
                 "archive_reason", "deleted_by"},
    "users": {"id", "name", "email", "phone_no", "type", "authentication_times", "status", "image",
              "archived_at"},
    "sessions": {"id", "user_id", "start_time", "end_time"},
    "laptop_specifications": {"asset_id", "series", "processor", "ram", "operating_system",
                              "charger", "screen_resolution", "storage", "archived_at"},
    "hard_disk_specifications": {"asset_id", "storage", "archived_at"},
}
COL_TYPES = {"created_by": "bigint", "created_at": "timestamp", "updated_at": "timestamp",
             "password": "varchar", "archived_at": "timestamp", "id": "bigint"}

ASSET_COLS = ["id", "brand", "model", "serial_no", "asset_type", "purchased_date",
              "warranty_start_date", "warranty_expiry_date", "created_by", "created_at",
              "updated_at", "archived_at", "is_available", "owned_by", "client_name", "status",
              "deleted_by", "archive_reason"]
REL_COLS = ["employee_id", "asset_id", "assigned_by", "assigned_date", "retrieved_date",
            "retrieval_reason", "archived_at"]
LAPTOP_COLS = ["asset_id", "series", "processor", "ram", "operating_system", "charger",
               "screen_resolution", "storage", "updated_at", "archived_at"]
EMP_COLS = ["name", "email", "phone_no", "status", "type", "archived_at", "archive_reason",
            "deleted_by", "created_at", "updated_at"]
USER_COLS = ["name", "email", "phone_no", "type", "authentication_times", "status", "image",
             "archived_at", "password", "created_at", "updated_at"]
SESSION_COLS = ["user_id", "start_time", "end_time"]


def _base(table: str, c: str, alias: str = "t") -> str:
    if c in FIXTURE_COLS[table]:
        return f"{alias}.{c}"
    return f"cast(null as {COL_TYPES[c]})"


def oracle_update(table: str, cols: list[str], req: str, keys: list[tuple[str, str]],
                  sets: dict[str, str], guard: str = "true", last: bool = True) -> str:
    """``UPDATE table`` by the last (or first) request per key, as a SELECT of the new table."""
    part = ", ".join(r for _, r in keys)
    order = "desc" if last else "asc"
    on = " and ".join(f"t.{tc} = w.{rc}" for tc, rc in keys)
    hit = f"(w.{keys[0][1]} is not null and ({guard}))"
    sel = ", ".join(
        f"case when {hit} then {sets[c]} else {_base(table, c)} end as {c}" if c in sets
        else f"{_base(table, c)} as {c}" for c in cols)
    return (f"select {sel} from {table} t left join (select * from (select *, row_number() over "
            f"(partition by {part} order by seq {order}) as rn from ({req}) q) x where rn = 1) w "
            f"on {on}")


def _ctes(needs, extra: dict[str, str]) -> str:
    head = duckdb_ctes(needs)
    return head + "".join(f", {k} as ({v})\n" for k, v in extra.items())


def T(spark, sf):
    return shared_tables(spark, sf)


def reg(name, fn, sql):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def _req(spark, t, text):
    names = ("assets", "employee", "employee_asset_relation", "users", "sessions")
    return spark.sql(text, **{n: getattr(t, TABLE_TO_ATTR[n]) for n in names if "{" + n + "}" in text})


def _bind(text: str) -> str:
    return text.replace("{assets}", "assets").replace("{employee}", "employee").replace(
        "{employee_asset_relation}", "employee_asset_relation").replace("{users}", "users").replace(
        "{sessions}", "sessions")


def _op(fn, req_sql, table, cols, rejects=False):
    def run(spark, sf):
        t = T(spark, sf)
        ch = fn(t, _req(spark, t, req_sql))
        if rejects:
            return ch.rejects
        return ch.tables[table].select(*cols)
    return run


# --------------------------------------------------------------------------- W1 register

REGISTER_REQ = f"""
select id as seq, {REQ_TS.format(s='id')} as req_ts, cast(1 as bigint) as actor_id,
  case when id % 3 = 0 then '' else brand end as brand, model, concat('R', serial_no) as serial_no,
  asset_type, date '1997-06-15' as purchased_date, date '1997-06-15' as warranty_start_date,
  date '1997-06-15' + 365 as warranty_expiry_date,
  case when id % 7 = 0 then 'nobody' else owned_by end as owned_by,
  concat('c', client_name) as client_name, 'S1' as series, 'cpu9' as processor, '16GB' as ram,
  'linux' as operating_system, cast(null as boolean) as charger, '4k' as screen_resolution,
  '1TB' as storage, 'android' as os_type, '1' as imei_1, '2' as imei_2,
  concat('SIM', serial_no) as sim_no, '7000000000' as phone_no
from {{assets}} where archived_at is not null"""

_REG_ACC = ("select * from req where brand <> '' and owned_by in ('remote_state', 'client') "
            "and asset_type in ('laptop', 'mouse', 'pen drive', 'hard disk', 'mobile', 'sim')")
_ASSET_NO_ID = [c for c in ASSET_COLS if c != "id"]
reg("w01_register_assets", _op(aw.register_assets, REGISTER_REQ, "assets", _ASSET_NO_ID),
    _ctes(["assets"], {"req": _bind(REGISTER_REQ), "acc": _REG_ACC})
    + "select " + ", ".join(f"{_base('assets', c)} as {c}" for c in _ASSET_NO_ID) + " from assets t "
    "union all select brand, model, serial_no, asset_type, purchased_date, warranty_start_date, "
    "warranty_expiry_date, actor_id, req_ts, cast(null as timestamp), cast(null as timestamp), true, "
    "owned_by, case when owned_by = 'remote_state' then '' else client_name end, 'available', "
    "cast(null as bigint), cast(null as string) from acc")
_LAPTOP_NO_KEY = [c for c in LAPTOP_COLS if c != "asset_id"] + ["created_at"]
reg("w01_register_laptop_specs",
    _op(aw.register_assets, REGISTER_REQ, "laptop_specifications", _LAPTOP_NO_KEY),
    _ctes(["assets", "laptop_specifications"], {"req": _bind(REGISTER_REQ), "acc": _REG_ACC})
    + "select series, processor, ram, operating_system, charger, screen_resolution, storage, "
    "cast(null as timestamp) as updated_at, archived_at, cast(null as timestamp) as created_at "
    "from laptop_specifications union all select series, processor, ram, operating_system, "
    "coalesce(charger, false), screen_resolution, storage, cast(null as timestamp), "
    "cast(null as timestamp), req_ts from acc where asset_type = 'laptop'")
reg("w01_register_rejects", _op(aw.register_assets, REGISTER_REQ, None, None, rejects=True),
    _ctes(["assets"], {"req": _bind(REGISTER_REQ)})
    + "select seq, case when owned_by not in ('remote_state', 'client') then 'Invalid OwnedBy' "
    "else 'Invalid Brand' end as reason from req where brand = '' or owned_by not in ('remote_state', 'client')")

# --------------------------------------------------------------------------- W2, W3 updates

UPDATE_REQ = f"""
select id * 10 as seq, {REQ_TS.format(s='id')} as req_ts, id,
  case when id % 9 = 0 then '' else concat(brand, '-u') end as brand,
  concat(model, '-u') as model, serial_no, purchased_date, warranty_start_date,
  case when id % 5 = 0 then cast(null as date) else warranty_expiry_date + 30 end as warranty_expiry_date,
  asset_type, 'S2' as series, 'cpu7' as processor, '32GB' as ram, 'bsd' as operating_system,
  true as charger, '8k' as screen_resolution, '2TB' as storage, cast(null as string) as os_type,
  cast(null as string) as imei_1, cast(null as string) as imei_2, cast(null as string) as sim_no,
  cast(null as string) as phone_no
from {{assets}} where asset_type in ('laptop', 'hard disk')
union all
select id * 10 + 1, {REQ_TS.format(s='id + 1')}, id, concat(brand, '-v'), cast(null as string),
  serial_no, purchased_date, warranty_start_date, warranty_expiry_date, asset_type, 'S3', 'cpu8',
  '64GB', 'os2', false, '16k', '4TB', null, null, null, null, null
from {{assets}} where asset_type = 'laptop' and id % 4 = 0"""

_UPD_ACC = "select * from req where brand <> '' and purchased_date is not null"
_UPD_ASSET_SETS = {
    "brand": "w.brand", "model": "coalesce(w.model, '')", "serial_no": "coalesce(w.serial_no, '')",
    "purchased_date": "w.purchased_date",
    "warranty_start_date": "coalesce(w.warranty_start_date, date '0001-01-01')",
    "warranty_expiry_date": "coalesce(w.warranty_expiry_date, date '0001-01-01')",
    "updated_at": "w.req_ts"}
reg("w02_update_assets", _op(aw.update_assets, UPDATE_REQ, "assets", ASSET_COLS),
    _ctes(["assets"], {"req": _bind(UPDATE_REQ)})
    + oracle_update("assets", ASSET_COLS, _UPD_ACC, [("id", "id")], _UPD_ASSET_SETS,
                    "t.archived_at is null"))
_LAPTOP_SETS = {c: f"coalesce(w.{c}, '')" for c in ("series", "processor", "ram", "operating_system",
                                                   "screen_resolution", "storage")}
_LAPTOP_SETS.update(charger="coalesce(w.charger, false)", updated_at="w.req_ts")
reg("w02_update_laptop_specs", _op(aw.update_assets, UPDATE_REQ, "laptop_specifications", LAPTOP_COLS),
    _ctes(["assets", "laptop_specifications"], {"req": _bind(UPDATE_REQ)})
    + oracle_update("laptop_specifications", LAPTOP_COLS,
                    _UPD_ACC + " and asset_type = 'laptop'", [("asset_id", "id")], _LAPTOP_SETS,
                    "t.archived_at is null"))
reg("w02_update_hard_disk_specs",
    _op(aw.update_assets, UPDATE_REQ, "hard_disk_specifications", ["asset_id", "storage", "archived_at"]),
    _ctes(["assets", "hard_disk_specifications"], {"req": _bind(UPDATE_REQ)})
    + oracle_update("hard_disk_specifications", ["asset_id", "storage", "archived_at"],
                    _UPD_ACC + " and asset_type = 'hard disk'", [("asset_id", "id")],
                    {"storage": "coalesce(w.storage, '')"}, "t.archived_at is null"))

WARRANTY_REQ = """
select id as seq, id as asset_id, warranty_expiry_date as warranty_start_date,
  warranty_expiry_date + 365 as warranty_expiry_date
from {assets} where warranty_expiry_date < date '1997-09-15'
union all
select id + 100000000, id, cast(null as date), warranty_expiry_date + 730
from {assets} where warranty_expiry_date < date '1997-07-15'"""
reg("w03_update_warranty", _op(aw.update_warranty, WARRANTY_REQ, "assets", ASSET_COLS),
    _ctes(["assets"], {"req": _bind(WARRANTY_REQ)})
    + oracle_update("assets", ASSET_COLS, "select * from req", [("id", "asset_id")],
                    {"warranty_start_date": "coalesce(w.warranty_start_date, date '0001-01-01')",
                     "warranty_expiry_date": "coalesce(w.warranty_expiry_date, date '0001-01-01')"},
                    "t.archived_at is null"))

# --------------------------------------------------------------------------- W4-W6 moves

ASSIGN_REQ = f"""
select id * 10 + 1 as seq, {REQ_TS.format(s='id')} as req_ts, cast(1 as bigint) as actor_id,
  case when id % 80 = 45 then cast(-1 as bigint) else id % 97 + 1 end as employee_id,
  id as asset_id, case when id % 13 = 0 then cast(null as date)
    else date '1997-06-01' + cast(id % 10 as int) end as assigned_date
from {{assets}} where is_available = true"""
_ASSIGN_ACC = ("select * from req r where exists (select 1 from employee e where e.id = r.employee_id) "
               "and exists (select 1 from assets a where a.id = r.asset_id)")
_AV_SETS = {"is_available": "false", "status": "'assigned'"}
reg("w04_assign_relations", _op(aw.assign_assets, ASSIGN_REQ, "employee_asset_relation", REL_COLS),
    _ctes(["assets", "employee", "employee_asset_relation"], {"req": _bind(ASSIGN_REQ), "acc": _ASSIGN_ACC})
    + "select " + ", ".join(REL_COLS) + " from employee_asset_relation union all "
    "select employee_id, asset_id, actor_id, coalesce(assigned_date, date '0001-01-01'), "
    "null, null, null from acc")
reg("w04_assign_assets", _op(aw.assign_assets, ASSIGN_REQ, "assets", ASSET_COLS),
    _ctes(["assets", "employee"], {"req": _bind(ASSIGN_REQ)})
    + oracle_update("assets", ASSET_COLS, _ASSIGN_ACC, [("id", "asset_id")], _AV_SETS,
                    "t.archived_at is null"))
reg("w04_assign_rejects", _op(aw.assign_assets, ASSIGN_REQ, None, None, rejects=True),
    _ctes(["assets", "employee"], {"req": _bind(ASSIGN_REQ)})
    + "select seq, 'unknown employee' as reason from req r "
    "where not exists (select 1 from employee e where e.id = r.employee_id)")

# Reassign: every asset currently held moves to another employee; every third held asset is
# moved twice (the chain rule); some requests carry an unparsable date or no reason.
REASSIGN_REQ = f"""
select asset_id * 10 + 1 as seq, {REQ_TS.format(s='asset_id')} as req_ts, cast(2 as bigint) as actor_id,
  asset_id, employee_id % 97 + 2 as employee_id, date '1997-06-10' as retrieved_date,
  case when asset_id % 17 = 0 then '' else 'moved' end as retrieval_reason,
  case when asset_id % 19 = 0 then 'not-a-date' else '1997-06-11' end as assigned_date
from {{employee_asset_relation}} where retrieved_date is null
union all
select asset_id * 10 + 2, {REQ_TS.format(s='asset_id + 1')}, cast(3 as bigint), asset_id,
  employee_id % 89 + 3, date '1997-06-12', 'moved again', '1997-06-13'
from {{employee_asset_relation}} where retrieved_date is null and asset_id % 3 = 0"""
_REASSIGN_ACC = ("select *, cast(assigned_date as date) as ad from req r where retrieval_reason <> '' "
                 "and try_cast(assigned_date as date) is not null "
                 "and exists (select 1 from employee e where e.id = r.employee_id) "
                 "and exists (select 1 from assets a where a.id = r.asset_id)")
_REASSIGN_REL = (
    _ctes(["assets", "employee", "employee_asset_relation"],
          {"req": _bind(REASSIGN_REQ), "acc": _REASSIGN_ACC})
    + ", closed as (" + oracle_update(
        "employee_asset_relation", REL_COLS, "select * from acc", [("asset_id", "asset_id")],
        {"retrieved_date": "w.retrieved_date", "retrieval_reason": "w.retrieval_reason",
         "archived_at": "w.req_ts"}, "t.archived_at is null", last=False) + ")\n"
    "select * from closed union all select employee_id, asset_id, actor_id, ad, "
    "lead(retrieved_date) over w, lead(retrieval_reason) over w, lead(req_ts) over w from acc "
    "window w as (partition by asset_id order by seq)")
reg("w05_reassign_relations",
    _op(aw.reassign_assets, REASSIGN_REQ, "employee_asset_relation", REL_COLS), _REASSIGN_REL)
reg("w05_reassign_assets", _op(aw.reassign_assets, REASSIGN_REQ, "assets", ASSET_COLS),
    _ctes(["assets", "employee", "employee_asset_relation"],
          {"req": _bind(REASSIGN_REQ), "acc": _REASSIGN_ACC})
    + oracle_update("assets", ASSET_COLS, "select * from acc", [("id", "asset_id")], _AV_SETS,
                    "t.archived_at is null"))
reg("w05_reassign_rejects", _op(aw.reassign_assets, REASSIGN_REQ, None, None, rejects=True),
    _ctes(["employee_asset_relation"], {"req": _bind(REASSIGN_REQ)})
    + "select seq, case when retrieval_reason = '' then 'Invalid RetrievalReason' "
    "else 'Invalid AssignedDate' end as reason from req "
    "where retrieval_reason = '' or try_cast(assigned_date as date) is null")

# Retrieve: every open relation whose asset's warranty has expired, some twice, plus pairs
# that match nothing (the asset still becomes available).
RETRIEVE_REQ = """
select r.id as seq, r.employee_id, r.asset_id,
  case when r.asset_id % 7 = 0 then cast(null as date) else date '1997-06-14' end as retrieved_date,
  case when r.asset_id % 5 = 0 then cast(null as string) else 'warranty over' end as retrieval_reason
from {employee_asset_relation} r join {assets} a on a.id = r.asset_id
where r.retrieved_date is null and a.warranty_expiry_date < date '1997-06-15'
union all
select r.id + 1, r.employee_id, r.asset_id, date '1997-06-20', 'again'
from {employee_asset_relation} r join {assets} a on a.id = r.asset_id
where r.retrieved_date is null and a.warranty_expiry_date < date '1997-06-15' and r.asset_id % 4 = 0
union all
select a.id * 1000 + 7, cast(-5 as bigint), a.id, date '1997-06-14', 'nothing'
from {assets} a where a.asset_type = 'mouse' and a.warranty_expiry_date < date '1996-01-01'"""
reg("w06_retrieve_relations",
    _op(aw.retrieve_assets, RETRIEVE_REQ, "employee_asset_relation", REL_COLS),
    _ctes(["assets", "employee_asset_relation"], {"req": _bind(RETRIEVE_REQ)})
    + oracle_update("employee_asset_relation", REL_COLS, "select * from req",
                    [("employee_id", "employee_id"), ("asset_id", "asset_id")],
                    {"retrieved_date": "coalesce(w.retrieved_date, date '0001-01-01')",
                     "retrieval_reason": "coalesce(w.retrieval_reason, '')"},
                    "t.retrieved_date is null", last=False))
reg("w06_retrieve_assets", _op(aw.retrieve_assets, RETRIEVE_REQ, "assets", ASSET_COLS),
    _ctes(["assets", "employee_asset_relation"], {"req": _bind(RETRIEVE_REQ)})
    + oracle_update("assets", ASSET_COLS, "select * from req", [("id", "asset_id")],
                    {"is_available": "true", "status": "'available'"}, "t.archived_at is null"))

# --------------------------------------------------------------------------- W7 delete

# Every asset whose warranty expired is deleted; held ones are rejected by the guard; the
# request names the stored type except for every eleventh asset (names 'laptop').
DELETE_REQ = f"""
select id as seq, {REQ_TS.format(s='id')} as req_ts, cast(4 as bigint) as actor_id, id,
  case when id % 11 = 0 then 'laptop' else asset_type end as asset_type,
  case when id % 2 = 0 then 'expired' else cast(null as string) end as delete_reason
from {{assets}} where warranty_expiry_date < date '1997-06-15'
union all
select id + 100000000, {REQ_TS.format(s='id + 3')}, cast(5 as bigint), id, 'laptop', 'again'
from {{assets}} where warranty_expiry_date < date '1997-06-15' and asset_type = 'laptop'"""
_DEL_ACC = ("select * from req r where not exists (select 1 from employee_asset_relation e "
            "where e.asset_id = r.id and e.retrieved_date is null and e.archived_at is null)")
reg("w07_delete_assets", _op(aw.delete_assets, DELETE_REQ, "assets", ASSET_COLS),
    _ctes(["assets", "employee_asset_relation"], {"req": _bind(DELETE_REQ)})
    + oracle_update("assets", ASSET_COLS, _DEL_ACC, [("id", "id")],
                    {"archived_at": "w.req_ts", "status": "'deleted'",
                     "archive_reason": "coalesce(w.delete_reason, '')", "deleted_by": "w.actor_id"},
                    "t.archived_at is null", last=False))
reg("w07_delete_laptop_specs", _op(aw.delete_assets, DELETE_REQ, "laptop_specifications", LAPTOP_COLS),
    _ctes(["assets", "employee_asset_relation", "laptop_specifications"], {"req": _bind(DELETE_REQ)})
    + oracle_update("laptop_specifications", LAPTOP_COLS, _DEL_ACC + " and asset_type = 'laptop'",
                    [("asset_id", "id")], {"archived_at": "w.req_ts"}, "t.archived_at is null",
                    last=False))
reg("w07_delete_rejects", _op(aw.delete_assets, DELETE_REQ, None, None, rejects=True),
    _ctes(["assets", "employee_asset_relation"], {"req": _bind(DELETE_REQ)})
    + "select seq, 'asset is assigned' as reason from req r where exists (select 1 from "
    "employee_asset_relation e where e.asset_id = r.id and e.retrieved_date is null "
    "and e.archived_at is null)")

# --------------------------------------------------------------------------- W3-W7 as one mixed log

_LOG_COLUMNS = ("{seq} as seq, {ts} as req_ts, cast(1 as bigint) as actor_id, '{op}' as operation, id as asset_id, {emp} as employee_id, "
                "{assigned} as assigned_date, {back} as retrieved_date, {why} as retrieval_reason, asset_type, {gone} as delete_reason, "
                "warranty_start_date, warranty_expiry_date + 100 as warranty_expiry_date from {{assets}} where {where}")


def _log_part(k, op, where, emp="id % 97 + 1", assigned="cast(null as string)", back="cast(null as date)", why="cast(null as string)",
              gone="cast(null as string)"):
    return "select " + _LOG_COLUMNS.format(seq=f"id * 10 + {k}", ts=REQ_TS.format(s=f"(id % 100000 + {k})"), op=op, where=where, emp=emp,
                                           assigned=assigned, back=back, why=why, gone=gone)


LOG_REQ = " union all ".join([
    _log_part(0, "retrieve_assets", "id % 7 < 3", emp="case when id % 50 = 1 then 7 else id % 89 + 1 end", back="date '1997-03-03'"),
    _log_part(1, "assign_assets", "id % 2 = 1", assigned="'1997-06-01'"),
    _log_part(2, "delete_assets", "id % 5 < 2", gone="'early'"),
    _log_part(3, "reassign_assets", "id % 3 = 0", emp="case when id % 60 = 33 then -1 else id % 89 + 1 end", assigned="'1997-06-03'",
              back="date '1997-06-03'", why="case when id % 27 = 0 then '' else 'moved' end"),
    _log_part(4, "update_warranty", "id % 4 = 1"),
    _log_part(5, "retrieve_assets", "id % 4 < 2", emp="case when id % 8 < 4 then id % 97 + 1 else id % 89 + 1 end", back="date '1997-06-05'",
              why="'back'"),
    _log_part(6, "delete_assets", "id % 3 < 2", gone="'late'"),
    _log_part(7, "assign_assets", "id % 11 = 4", emp="id % 89 + 1", assigned="'1997-06-07'"),
    _log_part(8, "update_warranty", "id % 9 = 1"),
    _log_part(9, "retrieve_assets", "id % 13 = 5", emp="id % 89 + 1")])

# One request at a time, said with EXISTS: what closes a relation, and whether one is open when a deletion arrives.
_LOG_CTES = {
    "req": _bind(LOG_REQ),
    "fine": """select r.*, a.id is not null as has_asset, e.id is not null as has_employee from req r
  left join assets a on a.id = r.asset_id left join employee e on e.id = r.employee_id""",
    "bad": """select seq, case when operation = 'reassign_assets' and retrieval_reason = '' then 'Invalid RetrievalReason'
    when operation in ('assign_assets', 'reassign_assets') and not has_employee then 'unknown employee' end as reason from fine""",
    "ok": "select req.* from req join bad using (seq) where reason is null",
    "born": """select -1 as born, asset_id, employee_id, assigned_by, assigned_date, retrieved_date, retrieval_reason, archived_at,
    id as was from employee_asset_relation
  union all select seq, asset_id, employee_id, actor_id, cast(assigned_date as date), null, null, null, null from ok
    where operation in ('assign_assets', 'reassign_assets')""",
    "fate": """select b.*,
    (select min(seq) from ok where operation = 'reassign_assets' and ok.asset_id = b.asset_id and seq > born) as moved,
    (select min(seq) from ok where operation = 'retrieve_assets' and ok.asset_id = b.asset_id
      and ok.employee_id = b.employee_id and seq > born) as fetched from born b""",
    "refused": """select distinct d.seq from ok d join fate f on f.asset_id = d.asset_id and d.operation = 'delete_assets'
      and f.born < d.seq and f.retrieved_date is null and f.archived_at is null
      and coalesce(f.moved, d.seq) >= d.seq and coalesce(f.fetched, d.seq) >= d.seq""",
    "done": "select * from ok anti join refused using (seq)",
}
_LOG_TABLES = ["assets", "employee", "employee_asset_relation"]
reg("w19_asset_log_relations", _op(apply_asset_log, LOG_REQ, "employee_asset_relation", REL_COLS), _ctes(_LOG_TABLES, _LOG_CTES) + """
select f.employee_id, f.asset_id, f.assigned_by, f.assigned_date,
  case when f.archived_at is null and m.seq is not null then m.retrieved_date
    when f.retrieved_date is null and t.seq is not null then coalesce(t.retrieved_date, date '0001-01-01') else f.retrieved_date end as retrieved_date,
  case when f.archived_at is null and m.seq is not null then m.retrieval_reason
    when f.retrieved_date is null and t.seq is not null then coalesce(t.retrieval_reason, '') else f.retrieval_reason end as retrieval_reason,
  case when f.archived_at is null and m.seq is not null then m.req_ts else f.archived_at end as archived_at
from fate f left join ok m on m.seq = f.moved left join ok t on t.seq = f.fetched""")
_LOG_ASSET_COLS = ["id", "status", "is_available", "warranty_start_date", "warranty_expiry_date", "archived_at", "archive_reason", "deleted_by"]
reg("w19_asset_log_assets", _op(apply_asset_log, LOG_REQ, "assets", _LOG_ASSET_COLS), _ctes(_LOG_TABLES, {**_LOG_CTES,
    "ends": "select asset_id, min(seq) as ending from done where operation = 'delete_assets' group by asset_id",
    "mine": """select d.* from done d left join ends using (asset_id) where ending is null or d.seq <= ending""",
    "how": """select asset_id, arg_max(operation = 'retrieve_assets', seq) filter (where operation in
      ('assign_assets', 'reassign_assets', 'retrieve_assets')) as free,
    max(seq) filter (where operation = 'update_warranty') as paper, max(seq) filter (where operation = 'delete_assets') as ending
    from mine group by asset_id"""}) + """
select a.id, case when a.archived_at is not null then a.status when how.ending is not null then 'deleted' when free then 'available'
    when not free then 'assigned' else a.status end as status,
  case when a.archived_at is null then coalesce(free, a.is_available) else a.is_available end as is_available,
  case when a.archived_at is null then coalesce(p.warranty_start_date, a.warranty_start_date) else a.warranty_start_date end as warranty_start_date,
  case when a.archived_at is null then coalesce(p.warranty_expiry_date, a.warranty_expiry_date) else a.warranty_expiry_date end as warranty_expiry_date,
  coalesce(a.archived_at, e.req_ts) as archived_at,
  case when a.archived_at is null and e.seq is not null then e.delete_reason else a.archive_reason end as archive_reason,
  case when a.archived_at is null and e.seq is not null then e.actor_id else a.deleted_by end as deleted_by
from assets a left join how on how.asset_id = a.id left join done p on p.seq = how.paper left join done e on e.seq = how.ending""")
reg("w19_asset_log_rejects", _op(apply_asset_log, LOG_REQ, None, None, rejects=True), _ctes(_LOG_TABLES, _LOG_CTES)
    + "select seq, reason from bad where reason is not null union all select seq, 'asset is assigned' from refused")

# --------------------------------------------------------------------------- W9-W11 employees

UPSERT_REQ = f"""
select id as seq, {REQ_TS.format(s='id')} as req_ts, concat(name, ' again') as name,
  case when id % 2 = 0 then email else concat('new', email) end as email,
  case when id % 9 = 0 then '12345' else phone_no end as phone_no,
  case when id % 11 = 0 then 'boss' else type end as type
from {{employee}}
union all
select id + 1000000000, {REQ_TS.format(s='id + 1')}, 'Second', concat('new', email), phone_no, type
from {{employee}} where id % 3 = 1"""
def _valid_emp(a: str) -> str:
    return (f"{a}.name <> '' and {a}.type in ('employee', 'intern', 'freelancer') "
            f"and regexp_matches({a}.email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') "
            f"and length({a}.phone_no) = 10 and regexp_matches({a}.phone_no, '^[-+]?[0-9]+(\\.[0-9]+)?$')")


_UPS_VALID = _valid_emp("r")
reg("w09_upsert_employees", _op(pw.upsert_employees, UPSERT_REQ, "employee", EMP_COLS),
    _ctes(["employee"], {"req": _bind(UPSERT_REQ),
                         "acc": f"select * from req r where {_valid_emp('r')} and not exists "
                                "(select 1 from employee e where e.email = r.email)"})
    + "select " + ", ".join(f"{_base('employee', c)} as {c}" for c in EMP_COLS) + " from employee t "
    "union all select name, email, phone_no, 'active', type, null, null, null, req_ts, null from "
    "(select *, row_number() over (partition by email order by seq) as rn from acc) x where rn = 1")

UPDATE_EMP_REQ = f"""
select id * 10 as seq, {REQ_TS.format(s='id')} as req_ts, id, concat(name, ' v2') as name,
  case when id % 13 = 0 then concat('emp', cast(id + 1 as string), '@example.com')
       else concat('v2.', email) end as email,
  phone_no, type,
  case when id % 4 = 0 then 'not_an_employee' when id % 23 = 0 then 'retired' else status end as status
from {{employee}}
union all
select id * 10 + 1, {REQ_TS.format(s='id + 2')}, id, concat(name, ' v3'), concat('v3.', email),
  phone_no, 'intern', 'active'
from {{employee}} where id % 6 = 0
union all
select id * 10 + 2, {REQ_TS.format(s='id')}, id + 1000000, 'nobody', concat('v2.', email), phone_no, type, 'active'
from {{employee}} where id % 5 = 1
union all
select -id, {REQ_TS.format(s='id')}, id, name, concat('v2.emp', cast(id + 1 as string), '@example.com'), phone_no, type, 'active'
from {{employee}} where archived_at is not null"""
_UE_LIVE = "exists (select 1 from employee l where l.id = {a}.id and l.archived_at is null)"
_UE_ACC = (f"select * from req r where {_valid_emp('r')} "
           "and r.status in ('active', 'deleted', 'not_an_employee') "
           "and not (status = 'not_an_employee' and exists (select 1 from employee_asset_relation x "
           "where x.employee_id = r.id and x.retrieved_date is null and x.archived_at is null)) "
           f"and {_UE_LIVE.format(a='r')} "
           "and not exists (select 1 from employee e where e.email = r.email and e.id <> r.id) "
           "and not exists (select 1 from req q where q.email = r.email and q.id <> r.id and q.seq < r.seq "
           f"and {_UE_LIVE.format(a='q')} "
           f"and {_valid_emp('q')} "
           "and q.status in ('active', 'deleted', 'not_an_employee') "
           "and not (q.status = 'not_an_employee' and exists (select 1 from employee_asset_relation y "
           "where y.employee_id = q.id and y.retrieved_date is null and y.archived_at is null)))")
reg("w10_update_employees", _op(pw.update_employees, UPDATE_EMP_REQ, "employee", ["id"] + EMP_COLS),
    _ctes(["employee", "employee_asset_relation"], {"req": _bind(UPDATE_EMP_REQ)})
    + oracle_update("employee", ["id"] + EMP_COLS, _UE_ACC, [("id", "id")],
                    {"name": "w.name", "email": "w.email", "phone_no": "w.phone_no",
                     "status": "w.status", "type": "w.type", "updated_at": "w.req_ts"},
                    "t.archived_at is null"))
reg("w10_update_rejects", _op(pw.update_employees, UPDATE_EMP_REQ, None, None, rejects=True), None)

DELETE_EMP_REQ = f"""
select id as seq, {REQ_TS.format(s='id')} as req_ts, cast(9 as bigint) as actor_id, id as employee_id,
  case when id % 2 = 0 then 'left' else cast(null as string) end as archive_reason
from {{employee}} where type = 'intern'
union all
select id + 1000000000, {REQ_TS.format(s='id + 5')}, cast(8 as bigint), id, 'again'
from {{employee}} where type = 'intern' and id % 5 = 0"""
_DE_ACC = ("select * from req r where not exists (select 1 from employee_asset_relation x "
           "where x.employee_id = r.employee_id and x.retrieved_date is null and x.archived_at is null)")
reg("w11_delete_employees", _op(pw.delete_employees, DELETE_EMP_REQ, "employee", ["id"] + EMP_COLS),
    _ctes(["employee", "employee_asset_relation"], {"req": _bind(DELETE_EMP_REQ)})
    + oracle_update("employee", ["id"] + EMP_COLS, _DE_ACC, [("id", "employee_id")],
                    {"archived_at": "w.req_ts", "archive_reason": "coalesce(w.archive_reason, '')",
                     "deleted_by": "w.actor_id", "status": "'deleted'"},
                    "t.archived_at is null", last=False))
reg("w11_delete_rejects", _op(pw.delete_employees, DELETE_EMP_REQ, None, None, rejects=True),
    _ctes(["employee", "employee_asset_relation"], {"req": _bind(DELETE_EMP_REQ)})
    + "select seq, 'asset is assigned to this employee' as reason from req r where exists "
    "(select 1 from employee_asset_relation x where x.employee_id = r.employee_id "
    "and x.retrieved_date is null and x.archived_at is null)")

# --------------------------------------------------------------------------- W12-W17 users

REGISTER_USER_REQ = f"""
select id as seq, {REQ_TS.format(s='id')} as req_ts, concat(name, '+') as name,
  case when id % 4 = 0 then email else concat('n', email) end as email,
  case when id % 4 = 0 then phone_no when id % 4 = 1 then phone_no
       else lpad(cast(id + 7 as string), 10, '6') end as phone_no,
  case when id % 6 = 5 then 'abc' else 'secret-pw' end as password,
  case when id % 17 = 0 then '' else concat('hash of ', name) end as password_hash
from {{users}}
union all
select id + 1000000, {REQ_TS.format(s='id + 1')}, 'dup', concat('n', email),
  lpad(cast(id + 500 as string), 10, '5'), 'secret-pw', concat('second ', name)
from {{users}} where id % 5 = 2
union all
select id + 2000000, {REQ_TS.format(s='id + 2')}, 'third', concat('n', email),
  case when id % 2 = 0 then lpad(cast(id + 500 as string), 10, '5') else lpad(cast(id + 7 as string), 10, '6') end,
  'secret-pw', concat('third ', name)
from {{users}} where id % 3 = 1"""
reg("w12_register_users", _op(pw.register_users, REGISTER_USER_REQ, "users", USER_COLS), None)
reg("w12_register_rejects", _op(pw.register_users, REGISTER_USER_REQ, None, None, rejects=True), None)

UPDATE_USER_REQ = f"""
select id * 10 as seq, {REQ_TS.format(s='id')} as req_ts, id, concat(name, ' u') as name,
  case when id % 7 = 0 then concat('user', cast(id + 1 as string), '@example.com')
       else concat('u.', email) end as email, phone_no, 'password1' as password,
  concat('hash 1 of ', name) as password_hash
from {{users}}
union all
select id * 10 + 1, {REQ_TS.format(s='id + 1')}, id, concat(name, ' w'), concat('w.', email),
  phone_no, 'password2', concat('hash 2 of ', name)
from {{users}} where id % 3 = 0
union all
select id * 10 + 2, {REQ_TS.format(s='id')}, id + 1000000, 'nobody', concat('u.', email), phone_no, 'password3', concat('hash 3 of ', name)
from {{users}} where id % 4 = 1
union all
select -id, {REQ_TS.format(s='id')}, id, name, concat('u.user', cast(id + 1 as string), '@example.com'), phone_no, 'password4', concat('hash 4 of ', name)
from {{users}} where archived_at is not null"""
reg("w13_update_users",
    _op(pw.update_users, UPDATE_USER_REQ, "users", ["id"] + USER_COLS),
    _ctes(["users"], {"req": _bind(UPDATE_USER_REQ)})
    + oracle_update("users", ["id"] + USER_COLS,
                    "select * from req r where not exists (select 1 from users u where "
                    "u.email = r.email and u.id <> r.id) and not exists (select 1 from users u "
                    "where u.phone_no = r.phone_no and u.id <> r.id and u.archived_at is null) "
                    "and not exists (select 1 from req q where (q.email = r.email or q.phone_no = r.phone_no) "
                    "and q.id <> r.id and q.seq < r.seq and exists (select 1 from users l where l.id = q.id "
                    "and l.archived_at is null))",
                    [("id", "id")], {"name": "w.name", "email": "w.email", "phone_no": "w.phone_no",
                                     "password": "w.password_hash", "updated_at": "w.req_ts"}, "t.archived_at is null"))

# Updates that take values from one another: the people of a block of eight share a few new e-mails and
# eight new phones (stored phones repeat across blocks), in an order that mixes them.  The oracle takes a block's requests one by one.
_TURN = "((id * 37 + {k} * 53) % 101) * 1000000 + id * 10 + {k}"
_SLOT = "concat('slot', cast(id - id % 8 as string), '.', cast((id * 5 + {k}) % 5 as string), '@example.com')"


def _turns(k: int) -> tuple[str, str]:
    return _TURN.format(k=k), _SLOT.format(k=k)


USER_TURNS_REQ = "\nunion all\n".join(
    f"select {seq} as seq, {REQ_TS.format(s=f'id + {k}')} as req_ts, id, concat(name, ' {k}') as name, "
    f"case when id % 3 = {k % 3} then email else {slot} end as email, "
    f"concat('55', lpad(cast(id - id % 8 + (id * 3 + {k}) % 8 as string), 8, '0')) as phone_no, "
    f"'secret-pw' as password, concat('hash {k} of ', name) as password_hash from {{users}}"
    for k in range(4) for seq, slot in [_turns(k)])
EMPLOYEE_TURNS_REQ = "\nunion all\n".join(
    f"select {seq} as seq, {REQ_TS.format(s=f'id + {k}')} as req_ts, id, concat(name, ' {k}') as name, "
    f"case when id % 4 = {k} then email else {slot} end as email, phone_no, type, 'active' as status from {{employee}}"
    for k in range(4) for seq, slot in [_turns(k)])


def _in_turn(table: str, phones: str | None) -> str:
    """CTEs ``run`` (seq, why): the requests ``req`` of each block of eight ids applied one by one."""
    own = "map_concat(r.{m}, map([o.id], ['']))"
    held = f"map(list(id), list({phones or 'email'}))"
    phone = f"when list_contains(map_values({own.format(m='phones')}), o.phone_no) then 'phone already used' " if phones else ""
    return (
        f", ordered as (select r.*, r.id - r.id % 8 as b, row_number() over (partition by r.id - r.id % 8 order by seq) as turn "
        f"from req r join {table} l on l.id = r.id and l.archived_at is null)"
        ", run as (select id - id % 8 as b, cast(0 as bigint) as turn, cast(null as bigint) as seq, cast(null as varchar) as why, "
        f"map(list(id), list(email)) as emails, {held} as phones from {table} group by id - id % 8 "
        "union all select b, turn, seq, why, case when why is null then map_concat(emails, map([id], [email])) else emails end, "
        "case when why is null then map_concat(phones, map([id], [phone_no])) else phones end from ("
        "select o.b, o.turn, o.seq, o.id, o.email, o.phone_no, r.emails, r.phones, case when "
        f"list_contains(map_values({own.format(m='emails')}), o.email) then 'email already used' {phone}end as why "
        "from run r join ordered o on o.b = r.b and o.turn = r.turn + 1) x)\n")


def _recursive(sql: str) -> str:
    return "with recursive" + sql.lstrip()[len("with"):]


_LIVE_PHONE = "case when archived_at is null then phone_no end"
_GRANTED = "select * from req where seq in (select seq from run where why is null)"
for _name, _fn, _table, _batch, _cols, _phones, _sets in (
        ("w13_update_users_in_turn", pw.update_users, "users", USER_TURNS_REQ, USER_COLS, _LIVE_PHONE,
         {"password": "w.password_hash"}),
        ("w10_update_employees_in_turn", pw.update_employees, "employee", EMPLOYEE_TURNS_REQ, EMP_COLS, None,
         {"status": "w.status", "type": "w.type"})):
    _head = _recursive(_ctes([_table], {"req": _bind(_batch)}) + _in_turn(_table, _phones))
    _sets = {"name": "w.name", "email": "w.email", "phone_no": "w.phone_no", "updated_at": "w.req_ts", **_sets}
    reg(_name, _op(_fn, _batch, _table, ["id"] + _cols),
        _head + oracle_update(_table, ["id"] + _cols, _GRANTED, [("id", "id")], _sets, "t.archived_at is null"))
    reg(_name + "_rejects", _op(_fn, _batch, None, None, rejects=True),
        _head + "select seq, why as reason from run where why is not null")

ACCESS_REQ = """
select id as seq, id as user_id,
  case when id % 3 = 0 then 'authorized' when id % 3 = 1 then 'blocked' else 'superuser' end as user_type
from {users}
union all select id + 1000000, id, 'unauthorized' from {users} where id % 6 = 1"""
reg("w14_set_access_type", _op(pw.set_access_type, ACCESS_REQ, "users", ["id"] + USER_COLS),
    _ctes(["users"], {"req": _bind(ACCESS_REQ)})
    + oracle_update("users", ["id"] + USER_COLS,
                    "select * from req where user_type in ('authorized', 'unauthorized', 'blocked')",
                    [("id", "user_id")], {"type": "w.user_type"}, "t.archived_at is null"))

IMAGE_REQ = """
select id as seq, id as user_id, concat('img/new/', cast(id as string)) as url from {users}
union all select id + 1000000, id, 'img/last' from {users} where id % 2 = 0"""
reg("w15_set_profile_image", _op(pw.set_profile_image, IMAGE_REQ, "users", ["id"] + USER_COLS),
    _ctes(["users"], {"req": _bind(IMAGE_REQ)})
    + oracle_update("users", ["id"] + USER_COLS, "select * from req", [("id", "user_id")],
                    {"image": "w.url"}, "t.archived_at is null"))

LOGOUT_REQ = f"""
select id as seq, {REQ_TS.format(s='id')} as req_ts, id as user_id from {{users}} where id % 2 = 1
union all select id + 1000, {REQ_TS.format(s='id + 10')}, id from {{users}} where id % 3 = 1"""
reg("w17_logout_sessions", _op(pw.logout_users, LOGOUT_REQ, "sessions", ["id"] + SESSION_COLS),
    _ctes(["users", "sessions"], {"req": _bind(LOGOUT_REQ)})
    + oracle_update("sessions", ["id"] + SESSION_COLS, "select * from req", [("user_id", "user_id")],
                    {"end_time": "w.req_ts"}))

# Login attempts: every event is an attempt by the user numbered ``user_id % 120`` (beyond the
# supplier range at small scale -> unknown e-mail); 'error' events carry a wrong password.
ATTEMPT_SQL = """
select event_id as seq, cast(ts as timestamp) as ts,
  case when event_id % 97 = 0 then concat('user', cast(user_id % 120 as string))
       else concat('user', cast(user_id % 120 as string), '@',
                   case when (user_id % 120) % 5 = 4 then 'other.org' else 'example.com' end) end as email,
  event_type <> 'error' as password_ok
from {events}"""


def _login(spark, sf, what):
    from fleetbook.sources.fixtures import read_source
    t = T(spark, sf)
    attempts = spark.sql(ATTEMPT_SQL, events=read_source(spark, sf, "events"))
    ch = lg.login_outcomes(t, attempts, COMPANY_DOMAIN)
    if what == "outcomes":
        return ch.tables["login_outcomes"].select("seq", "email", "outcome")
    if what == "users":
        return ch.tables["users"].select("id", "type", "status", "authentication_times")
    return ch.tables["sessions"].select("user_id", "start_time", "end_time")


def _login_cte(needs):
    return duckdb_ctes(needs) + _LOGIN_BODY


_LOGIN_BODY = (", att as (" + ATTEMPT_SQL.replace("{events}", "events") + ")"
              ", j as (select a.*, u.id as user_id, u.type, u.authentication_times as t0, "
              "case when instr(a.email, '@') = 0 then null else split_part(a.email, '@', 2) end as dom "
              "from att a left join users u on u.email = a.email)"
              ", pre as (select *, case when dom is null then 'invalid' "
              f"when dom <> '{COMPANY_DOMAIN}' then 'bad_domain' when user_id is null then 'wrong_email' "
              "when not password_ok then 'wrong_password' when t0 is null then 'invalid' end as p from j)"
              ", ranked as (select *, case when p is null then row_number() over "
              "(partition by user_id, p is null order by seq) end as k from pre)"
              ", outc as (select *, coalesce(p, case "
              "when type = 'unauthorized' and t0 >= 0 and k + (case when t0 > 0 then 1 else 0 end) = 1 then 'warned' "
              "when type = 'unauthorized' and t0 >= 0 and k + (case when t0 > 0 then 1 else 0 end) = 2 then 'blocked_now' "
              "when type = 'unauthorized' and t0 >= 0 then 'blocked' when type = 'blocked' then 'blocked' "
              "else 'session' end) as outcome from ranked)\n")
reg("w16_login_outcomes", lambda s, sf: _login(s, sf, "outcomes"),
    _login_cte(["users"]) + "select seq, email, outcome from outc")
# Users: replay the valid attempts' state changes in order (warned / blocked_now steps).
reg("w16_login_users", lambda s, sf: _login(s, sf, "users"),
    _login_cte(["users"]) + ", steps as (select user_id, count(*) filter (where outcome = 'warned') as nw, "
    "count(*) filter (where outcome = 'blocked_now') as nb from outc group by user_id)\n"
    "select u.id, case when coalesce(nb, 0) > 0 then 'blocked' else u.type end as type, "
    "case when coalesce(nb, 0) > 0 then 'black_listed' when coalesce(nw, 0) > 0 then 'warned' "
    "else u.status end as status, cast(u.authentication_times + coalesce(nw, 0) + coalesce(nb, 0) "
    "as integer) as authentication_times from users u left join steps s on s.user_id = u.id")
reg("w16_login_sessions", lambda s, sf: _login(s, sf, "sessions"),
    _login_cte(["users", "sessions"])
    + "select user_id, start_time, end_time from sessions union all "
    "select user_id, ts, cast(null as timestamp) from outc where outcome = 'session'")

# --------------------------------------------------------------------------- oracles for rejects

_USER_RULES = [
    ("Name", "coalesce(name, '') = ''"),
    ("Email", "(coalesce(email, '') = '' or not regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'))"),
    ("PhoneNo", "(coalesce(phone_no, '') = '' or length(phone_no) <> 10 "
                "or not regexp_matches(phone_no, '^[-+]?[0-9]+(\\.[0-9]+)?$'))"),
    ("Password", "(coalesce(password, '') = '' or length(password) < 6)"),
]
_EMP_RULES = [
    ("Name", "coalesce(name, '') = ''"),
    ("Type", "(coalesce(type, '') = '' or type not in ('employee', 'intern', 'freelancer'))"),
    ("Email", _USER_RULES[1][1]), ("PhoneNo", _USER_RULES[2][1]),
]


def _last_invalid(rules) -> str:
    """'Invalid <last failing field>' (NULL when valid), as the validation message."""
    return "case " + " ".join(f"when {p} then 'Invalid {n}'" for n, p in reversed(rules)) + " end"


# One by one: the state is all e-mails, the phones of live users and their (e-mail, phone) pairs.
_W12_RUN = (
    f", checked as (select *, coalesce({_last_invalid(_USER_RULES)}, "
    "case when coalesce(password_hash, '') = '' then 'Invalid PasswordHash' end) as invalid from req)"
    ", ordered as (select *, row_number() over (order by seq) as turn from checked where invalid is null)"
    ", run as (select cast(0 as bigint) as turn, cast(null as bigint) as seq, cast(null as varchar) as why, "
    "list(email) as emails, list(phone_no) filter (where archived_at is null) as phones, "
    "list(email || ' ' || phone_no) filter (where archived_at is null) as pairs from users "
    "union all select turn, seq, why, case when why is null then list_append(emails, email) else emails end, "
    "case when why is null then list_append(phones, phone_no) else phones end, "
    "case when why is null then list_append(pairs, email || ' ' || phone_no) else pairs end from ("
    "select o.turn, o.seq, o.email, o.phone_no, r.emails, r.phones, r.pairs, "
    "case when list_contains(r.pairs, o.email || ' ' || o.phone_no) then 'user already exists' "
    "when list_contains(r.emails, o.email) then 'email already used' "
    "when list_contains(r.phones, o.phone_no) then 'phone already used' end as why "
    "from run r join ordered o on o.turn = r.turn + 1) x)\n")
ORACLE["w12_register_users"] = (
    _recursive(_ctes(["users"], {"req": _bind(REGISTER_USER_REQ)}) + _W12_RUN)
    + "select " + ", ".join(f"{_base('users', c)} as {c}" for c in USER_COLS)
    + " from users t union all select name, email, phone_no, 'authorized', 0, 'white_listed', "
    "cast(null as varchar), cast(null as timestamp), password_hash, req_ts, cast(null as timestamp) "
    "from req where seq in (select seq from run where why is null)")
ORACLE["w12_register_rejects"] = (
    _recursive(_ctes(["users"], {"req": _bind(REGISTER_USER_REQ)}) + _W12_RUN)
    + "select seq, invalid as reason from checked where invalid is not null union all "
    "select seq, why from run where why is not null")

_W10_STEPS = (
    f", checked as (select *, coalesce({_last_invalid(_EMP_RULES)}, case when status is null or status not in "
    "('active', 'deleted', 'not_an_employee') then 'Invalid Status' end) as invalid from req)"
    ", valid as (select * from checked where invalid is null)"
    ", guarded as (select *, status = 'not_an_employee' and exists (select 1 from employee_asset_relation x "
    "where x.employee_id = v.id and x.retrieved_date is null and x.archived_at is null) as busy from valid v)"
    f", passed as (select * from guarded g where not busy and {_UE_LIVE.format(a='g')})"
    ", flags as (select p.*, exists (select 1 from employee e where e.email = p.email and e.id <> p.id) "
    "or exists (select 1 from passed q where q.email = p.email and q.id <> p.id and q.seq < p.seq) "
    "as used from passed p)\n")
ORACLE["w10_update_rejects"] = (
    _ctes(["employee", "employee_asset_relation"], {"req": _bind(UPDATE_EMP_REQ)}) + _W10_STEPS
    + "select seq, invalid as reason from checked where invalid is not null union all "
    "select seq, 'asset is assigned to this employee' from guarded where busy union all "
    "select seq, 'email already used' from flags where used")

# --------------------------------------------------------------------------- W8

AVAILABILITY_REQ = """
select id as seq, id as asset_id, warranty_expiry_date >= date '1997-06-15' as available
from {assets} where asset_type in ('mouse', 'sim')
union all
select id + 100000000, id, false from {assets} where asset_type = 'sim' and id % 4 = 1"""


def _w08(spark, sf):
    t = T(spark, sf)
    return aw.set_availability(t.assets, _req(spark, t, AVAILABILITY_REQ)).select(*ASSET_COLS)


reg("w08_set_availability", _w08,
    _ctes(["assets"], {"req": _bind(AVAILABILITY_REQ)})
    + oracle_update("assets", ASSET_COLS, "select * from req", [("id", "asset_id")],
                    {"is_available": "w.available",
                     "status": "case when w.available then 'available' else 'assigned' end"},
                    "t.archived_at is null"))
