"""One test per stored-query quirk (SURVEY K-numbers) on tiny hand-made tables."""
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from fleetbook.functions.filters import ListFilter
from fleetbook.functions.predicates import contains_ci, is_expired, within_months
from fleetbook.functions.text import hash_text, phone_is_integer, trim_after, trim_all
from fleetbook.operators import access, asset_writes, assets, dashboard, employees, people_writes
from helpers import D, TS, rows, tables

AS_OF = dt.datetime(1997, 6, 15, 12, 0, 0)
ARCH = TS(1997, 1, 1)


def asset(i, **kw):
    base = dict(id=i, brand=f"Brand#{i}", model="M", serial_no=f"SN{i}", asset_type="laptop",
                purchased_date=D(1995, 1, 1), warranty_start_date=D(1995, 1, 1),
                warranty_expiry_date=D(1999, 1, 1), status="available", is_available=True,
                owned_by="client", client_name="c")
    base.update(kw)
    return base


def emp(i, **kw):
    base = dict(id=i, name=f"Customer#{i}", email=f"emp{i}@example.com", phone_no="8888888888",
                status="active", type="employee")
    base.update(kw)
    return base


def rel(i, e, a, **kw):
    base = dict(id=i, employee_id=e, asset_id=a, assigned_by=1, assigned_date=D(1996, 1, 1))
    base.update(kw)
    return base


# ----------------------------------------------------------------------------- list semantics

def test_k1_flags_or_without_parentheses(spark):
    t = tables(spark, assets=[asset(1, status="available", asset_type="mouse"),
                              asset(2, status="deleted", asset_type="mouse"),
                              asset(3, status="deleted", asset_type="laptop")])
    flt = ListFilter(available=True, deleted=True, asset_types=("laptop",), pagination=False)
    faithful = rows(assets.asset_export(t, flt, AS_OF), "id")
    strict = rows(assets.asset_export(t, flt, AS_OF, strict=True), "id")
    assert faithful == [(1,), (3,)]
    assert strict == [(3,)]


def test_k2_status_list_one_row_per_relation(spark):
    t = tables(spark, assets=[asset(1, status="assigned", is_available=False)],
               employee=[emp(10), emp(11)],
               relation=[rel(100, 10, 1, retrieved_date=D(1996, 2, 1)), rel(101, 11, 1)])
    out = assets.asset_list_by_status(t, ListFilter(assigned=True), AS_OF)
    assert rows(out, "total_count", "id", "assigned_to_id") == [(2, 1, 10), (2, 1, 11)]


def test_k3_open_relation_wins_then_latest_retrieved(spark):
    rels = [rel(1, 10, 1, retrieved_date=D(1996, 1, 5)), rel(2, 11, 1),
            rel(3, 12, 1, retrieved_date=D(1996, 2, 1))]
    emps = [emp(10), emp(11), emp(12)]
    a = [asset(1, is_available=False, status="assigned")]
    t = tables(spark, assets=a, employee=emps, relation=rels)
    assert rows(assets.asset_list(t, ListFilter(), AS_OF), "assigned_to_id") == [(11,)]
    t2 = tables(spark, assets=a, employee=emps, relation=[rels[0], rels[2]])
    assert rows(assets.asset_list(t2, ListFilter(), AS_OF), "assigned_to_id") == [(12,)]


def test_k4_archived_holders_hide_asset_but_unassigned_stays(spark):
    t = tables(spark, assets=[asset(1), asset(2)], employee=[emp(7, archived_at=ARCH)],
               relation=[rel(1, 7, 1, retrieved_date=D(1996, 1, 1))])
    out = assets.asset_list(t, ListFilter(), AS_OF)
    assert rows(out, "id", "total_count") == [(2, 1)]


def test_k5_holder_only_when_not_available(spark):
    t = tables(spark, assets=[asset(1, is_available=True)], employee=[emp(10)],
               relation=[rel(1, 10, 1)])
    assert rows(assets.asset_list(t, ListFilter(), AS_OF), "assigned_to_id", "name") == [(None, "")]


def test_k6_warranty_boundaries():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(D(1997, 6, 15),), (D(1997, 6, 14),), (D(1997, 9, 15),),
                                (D(1997, 9, 16),)], "d date")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "d", within_months("d", 3, AS_OF).alias("w"), is_expired("d", AS_OF).alias("x")).collect()}
    assert got[D(1997, 6, 15)] == (False, False)  # today: in neither set
    assert got[D(1997, 6, 14)] == (False, True)
    assert got[D(1997, 9, 15)] == (True, False)
    assert got[D(1997, 9, 16)] == (False, False)


def test_k7_warranty_parameter_parsing():
    assert ListFilter.from_query("warranty=0").is_expired
    assert not ListFilter.from_query("warranty=-1").is_expired
    assert not ListFilter.from_query("").is_expired
    assert ListFilter.from_query("warranty=3").warranty == 3
    with pytest.raises(ValueError):
        ListFilter.from_query("warranty=%203")
    assert ListFilter.from_query("limit=5&limit=7").limit == 5  # first value wins
    assert ListFilter.from_query("pagination=f").pagination is False
    with pytest.raises(ValueError):
        ListFilter.from_query("pagination=maybe")
    assert ListFilter.from_query("assetType=laptop,").asset_types == ("laptop", "")


def test_k8_ilike_wildcards_and_escapes(spark):
    df = spark.createDataFrame([("abc",), ("a_c",), ("xq",), ("a%c",)], "s string")

    def hits(term):
        return sorted(r[0] for r in df.filter(contains_ci("s", term)).collect())
    assert hits("A_C") == ["a%c", "a_c", "abc"]
    assert hits("a\\_c") == ["a_c"]
    assert hits("\\q") == ["xq"]  # backslash before an ordinary char = the char
    assert hits("a\\%") == ["a%c"]


def test_k9_paging(spark):
    t = tables(spark, assets=[asset(i) for i in range(1, 6)])
    page = assets.asset_list(t, ListFilter(limit=2, page=1), AS_OF)
    assert rows(page, "id", "total_count") == [(3, 5), (4, 5)]
    assert assets.asset_list(t, ListFilter(limit=2, page=9), AS_OF).count() == 0
    with pytest.raises(ValueError):
        assets.asset_list(t, ListFilter(limit=-1), AS_OF)


def test_k10_pagination_false_only_in_status_list(spark):
    t = tables(spark, assets=[asset(i) for i in range(1, 13)])
    export = assets.asset_list_by_status(t, ListFilter(available=True, pagination=False), AS_OF)
    assert export.count() == 12 and "total_count" not in export.columns
    assert assets.asset_list(t, ListFilter(pagination=False), AS_OF).count() == 10


# ----------------------------------------------------------------------------- employees

def test_k11_id_with_empty_term_filters_nothing(spark):
    t = tables(spark, employee=[emp(1), emp(2), emp(3)])
    assert employees.employee_rows(t, ListFilter(employee_id="2")).count() == 3
    only = employees.employee_rows(t, ListFilter(employee_id="2", name="zzz"))
    assert rows(only, "id") == [(2,)]


def test_k12_detail_attaches_history_to_first_row(spark):
    t = tables(spark, employee=[emp(1), emp(2)], assets=[asset(5)], relation=[rel(9, 2, 5)])
    out = employees.employee_detail(t, ListFilter(), employee_id="2")
    assert rows(out, "id", "h_id") == [(1, 5), (2, None)]


def test_k13_archived_visible_with_deleted_flag(spark):
    t = tables(spark, employee=[emp(1, status="deleted", archived_at=ARCH)])
    assert employees.employee_rows(t, ListFilter()).count() == 0
    assert employees.employee_rows(t, ListFilter(deleted=True)).count() == 1


def test_k14_both_status_flags(spark):
    t = tables(spark, employee=[emp(1, name="Ann", status="deleted", archived_at=ARCH),
                                emp(2, name="Bob", status="deleted", archived_at=ARCH),
                                emp(3, name="Cid", status="not_an_employee")])
    flt = ListFilter(name="ann", deleted=True, not_an_employee=True)
    assert rows(employees.employee_rows(t, flt), "id") == [(1,), (3,)]
    assert rows(employees.employee_rows(t, flt, strict=True), "id") == [(1,)]


def test_k15_k16_type_filter_and_quantity(spark):
    t = tables(spark, employee=[emp(1), emp(2)],
               assets=[asset(10, asset_type="laptop"), asset(11, asset_type="mouse")],
               relation=[rel(1, 1, 10, retrieved_date=D(1996, 5, 1)), rel(2, 1, 11), rel(3, 1, 10)])
    all_rows = rows(employees.employee_rows(t, ListFilter()), "id", "asset_quantity")
    assert all_rows == [(1, 3), (2, 0)]  # closed relations count too
    typed = rows(employees.employee_rows(t, ListFilter(asset_types=("laptop",))), "id", "asset_quantity")
    assert typed == [(1, 2)]  # employee 2 has no laptop relation: gone


# ----------------------------------------------------------------------------- specs, picker

def test_k18_specs_inner_and_caller_type(spark):
    t = tables(spark, assets=[asset(1, asset_type="laptop"), asset(2, asset_type="mobile")],
               laptop=[dict(id=1, asset_id=1, series="s", archived_at=ARCH)])
    assert rows(assets.asset_specs(t, "laptop"), "asset_id", "series") == [(1, "s")]
    assert assets.asset_specs(t, "mouse").count() == 2  # no family table: every asset


def test_k19_picker_keeps_specless_assets(spark):
    t = tables(spark, assets=[asset(1, brand="B", model="M", asset_type="laptop"),
                              asset(2, brand="B", model="M", asset_type="mobile"),
                              asset(3, brand="B", model="M", asset_type="mobile")],
               mobile=[dict(id=2, asset_id=2, imei_1="111"),
                       dict(id=3, asset_id=3, imei_1="333", archived_at=ARCH)])
    assert rows(assets.available_mobiles(t, "B", "M")) == [(1, None), (2, "111")]
    with pytest.raises(ValueError):
        assets.available_picker(t)


# ----------------------------------------------------------------------------- dashboard, access

def test_k20_k21_dashboard(spark):
    t = tables(spark, assets=[asset(1), asset(2, archived_at=ARCH, asset_type="sim")],
               relation=[rel(1, 1, 1), rel(2, 1, 1), rel(3, 1, 2)])
    tot = rows(dashboard.fleet_totals(t))
    assert tot == [(1, 3, -2)]  # available can go negative
    other = dashboard.type_counts(t, "other").first()
    assert (other["laptop_quantity"], other["sim_quantity"]) == (1, 1)
    dist = dashboard.type_counts(t, "distributed").first()
    assert (dist["laptop_quantity"], dist["sim_quantity"]) == (2, 0)
    empty = dashboard.type_counts(tables(spark), "total").first()
    assert empty["laptop_quantity"] == 0


def test_k22_access_classes(spark):
    users = [dict(id=1, name="a", email="a@x.y", phone_no="1", type="authorized"),
             dict(id=2, name="b", email="b@x.y", phone_no="2", type="blocked"),
             dict(id=3, name="c", email="c@x.y", phone_no="3", type=None)]
    t = tables(spark, users=users, sessions=[dict(id=1, user_id=2, start_time=TS(1997, 1, 1))])
    assert rows(access.access_report(t, "authorized"), "id") == [(1,)]
    assert rows(access.access_report(t, "whatever"), "id", "start_time") == [(2, TS(1997, 1, 1))]


def test_k29_existing_user_needs_email_and_phone(spark):
    t = tables(spark, users=[dict(id=1, name="a", email="a@x.y", phone_no="1")])
    req = spark.createDataFrame([(1, "a@x.y", "1"), (2, "a@x.y", "2"), (3, "b@x.y", "1")],
                                "seq long, email string, phone_no string")
    assert rows(access.existing_users(t, req), "seq") == [(1,)]


def test_r19_latest_open_session_ties_by_id(spark):
    s = [dict(id=1, user_id=5, start_time=TS(1997, 1, 2)), dict(id=2, user_id=5, start_time=TS(1997, 1, 2)),
         dict(id=3, user_id=5, start_time=TS(1997, 1, 3), end_time=TS(1997, 1, 4))]
    t = tables(spark, sessions=s)
    assert rows(access.latest_open_session(t)) == [(5, 2, TS(1997, 1, 2))]


# ----------------------------------------------------------------------------- writes

def _req(spark, rows_, schema):
    return spark.createDataFrame(rows_, schema)


def test_k23_logout_ends_every_session(spark):
    t = tables(spark, sessions=[dict(id=1, user_id=5, start_time=TS(1997, 1, 1), end_time=TS(1997, 1, 2)),
                                dict(id=2, user_id=5, start_time=TS(1997, 1, 3))])
    req = _req(spark, [(1, TS(1997, 2, 1), 5)], "seq long, req_ts timestamp, user_id long")
    out = people_writes.logout_users(t, req).tables["sessions"]
    assert rows(out, "id", "end_time") == [(1, TS(1997, 2, 1)), (2, TS(1997, 2, 1))]


REASSIGN = ("seq long, req_ts timestamp, actor_id long, asset_id long, employee_id long, "
            "retrieved_date date, retrieval_reason string, assigned_date string")


def test_k24_k34_reassign_closes_retrieved_rows_and_fk_rolls_back(spark):
    t = tables(spark, assets=[asset(1, is_available=False, status="assigned")],
               employee=[emp(10), emp(11)],
               relation=[rel(1, 10, 1, retrieved_date=D(1996, 3, 1), retrieval_reason="r")])
    ok = _req(spark, [(1, TS(1997, 2, 1), 9, 1, 11, D(1997, 2, 1), "moved", "1997-02-02")], REASSIGN)
    out = asset_writes.reassign_assets(t, ok).tables["employee_asset_relation"]
    assert rows(out, "employee_id", "retrieved_date", "retrieval_reason") == [
        (10, D(1997, 2, 1), "moved"), (11, None, None)]
    bad = _req(spark, [(1, TS(1997, 2, 1), 9, 1, 99, D(1997, 2, 1), "moved", "1997-02-02")], REASSIGN)
    ch = asset_writes.reassign_assets(t, bad)
    assert rows(ch.tables["employee_asset_relation"], "retrieved_date") == [(D(1996, 3, 1),)]
    assert rows(ch.rejects, "reason") == [("unknown employee",)]


def test_k25_retrieve_sets_available_without_match(spark):
    t = tables(spark, assets=[asset(1, is_available=False, status="assigned")])
    req = _req(spark, [(1, 5, 1, D(1997, 1, 1), "x")],
               "seq long, employee_id long, asset_id long, retrieved_date date, retrieval_reason string")
    out = asset_writes.retrieve_assets(t, req).tables["assets"]
    assert rows(out, "is_available", "status") == [(True, "available")]


def test_k26_assign_twice_accepted(spark):
    t = tables(spark, assets=[asset(1)], employee=[emp(10)])
    req = _req(spark, [(1, TS(1997, 1, 1), 9, 10, 1, D(1997, 1, 1)), (2, TS(1997, 1, 2), 9, 10, 1, None)],
               "seq long, req_ts timestamp, actor_id long, employee_id long, asset_id long, assigned_date date")
    ch = asset_writes.assign_assets(t, req)
    assert rows(ch.tables["employee_asset_relation"], "assigned_date") == [
        (D(1, 1, 1),), (D(1997, 1, 1),)]
    assert rows(ch.tables["assets"], "is_available", "status") == [(False, "assigned")]


def test_k27_upsert_keeps_existing_row(spark):
    t = tables(spark, employee=[emp(1, name="Old", status="deleted", archived_at=ARCH)])
    req = _req(spark, [(1, TS(1997, 1, 1), "New", "emp1@example.com", "8888888888", "intern"),
                       (2, TS(1997, 1, 1), "Fresh", "x@example.com", "8888888888", "intern"),
                       (3, TS(1997, 1, 1), "Again", "x@example.com", "8888888888", "intern")],
               "seq long, req_ts timestamp, name string, email string, phone_no string, type string")
    out = people_writes.upsert_employees(t, req).tables["employee"]
    assert rows(out, "name", "status") == [("Fresh", "active"), ("Old", "deleted")]


def test_k28_delete_archives_spec_of_request_type(spark):
    t = tables(spark, assets=[asset(1, asset_type="laptop")],
               laptop=[dict(id=1, asset_id=1)], mobile=[dict(id=1, asset_id=1)])
    req = _req(spark, [(1, TS(1997, 1, 1), 9, 1, "mobile", "gone"), (2, TS(1997, 1, 2), 9, 1, "laptop", "x")],
               "seq long, req_ts timestamp, actor_id long, id long, asset_type string, delete_reason string")
    ch = asset_writes.delete_assets(t, req)
    assert rows(ch.tables["mobile_specifications"], "archived_at") == [(TS(1997, 1, 1),)]
    assert rows(ch.tables["laptop_specifications"], "archived_at") == [(TS(1997, 1, 2),)]
    assert rows(ch.tables["assets"], "status", "archive_reason") == [("deleted", "gone")]


def test_k30_warranty_update_leaves_updated_at(spark):
    t = tables(spark, assets=[asset(1)])
    req = _req(spark, [(1, 1, D(1998, 1, 1), D(2000, 1, 1))],
               "seq long, asset_id long, warranty_start_date date, warranty_expiry_date date")
    out = asset_writes.update_warranty(t, req).tables["assets"]
    assert rows(out, "warranty_expiry_date", "updated_at") == [(D(2000, 1, 1), None)]


def test_k31_asset_history_drops_archived_assets(spark):
    t = tables(spark, assets=[asset(1), asset(2, archived_at=ARCH)],
               relation=[rel(1, 5, 1), rel(2, 5, 2)])
    assert rows(assets.asset_history(t), "id") == [(1,)]


def test_k33_enum_columns_reject_unknown_values(spark):
    t = tables(spark, employee=[emp(1)])
    req = _req(spark, [(1, TS(1997, 1, 1), 1, "N", "emp1@example.com", "8888888888", "employee", "")],
               "seq long, req_ts timestamp, id long, name string, email string, phone_no string, "
               "type string, status string")
    ch = people_writes.update_employees(t, req)
    assert rows(ch.rejects, "reason") == [("Invalid Status",)]


def test_k32_text_helpers(spark):
    df = spark.createDataFrame([("a-b c-d", "x@y@z", "hello", " 12")], "p string, e string, h string, n string")
    r = df.select(trim_all("p", "-"), trim_after("e", "@"), hash_text("h"), phone_is_integer("n")).first()
    assert r[0] == "ab cd" and r[1] == "x"
    assert r[2] == hashlib.sha512(b"hello").hexdigest()
    assert r[3] is False  # Go's Atoi rejects surrounding spaces


# ----------------------------------------------------------------------------- login policy

def test_w16_login_policy(spark):
    from fleetbook.operators.login import login_outcomes
    users = [dict(id=1, name="u", email="u@co.io", phone_no="1", type="unauthorized", authentication_times=0,
                  status="white_listed"),
             dict(id=2, name="v", email="v@co.io", phone_no="2", type="authorized", authentication_times=0,
                  status="white_listed"),
             dict(id=3, name="w", email="w@co.io", phone_no="3", type="unauthorized", authentication_times=4,
                  status="warned")]
    t = tables(spark, users=users)
    att = spark.createDataFrame(
        [(1, TS(1997, 1, 1), "u@co.io", True), (2, TS(1997, 1, 2), "u@co.io", False),
         (3, TS(1997, 1, 3), "u@co.io", True), (4, TS(1997, 1, 4), "u@co.io", True),
         (5, TS(1997, 1, 5), "v@co.io", True), (6, TS(1997, 1, 6), "x@other.io", True),
         (7, TS(1997, 1, 7), "nobody", True), (8, TS(1997, 1, 8), "w@co.io", True),
         (9, TS(1997, 1, 9), "z@co.io", True)],
        "seq long, ts timestamp, email string, password_ok boolean")
    ch = login_outcomes(t, att, "co.io")
    got = dict(rows(ch.tables["login_outcomes"], "seq", "outcome"))
    assert got == {1: "warned", 2: "wrong_password", 3: "blocked_now", 4: "blocked", 5: "session",
                   6: "bad_domain", 7: "invalid", 8: "blocked_now", 9: "wrong_email"}
    state = {r[0]: r[1:] for r in rows(ch.tables["users"], "id", "type", "status", "authentication_times")}
    assert state[1] == ("blocked", "black_listed", 2)
    assert state[2] == ("authorized", "white_listed", 0)
    assert state[3] == ("blocked", "black_listed", 5)
    assert ch.tables["sessions"].count() == 1


@pytest.mark.parametrize("flt", [ListFilter(limit=7, page=3), ListFilter(asset_types=("laptop", "sim"), limit=4),
                                 ListFilter(warranty=0, is_expired=True, limit=6, page=1), ListFilter(limit=9, page=7)])
def test_pages_are_slices_of_the_whole(spark, small, flt):
    """A page is the slice of the ordered unpaged rows, and carries their number."""
    whole = rows(assets.asset_list_rows(small, flt, AS_OF))
    page = rows_sorted(rows(assets.asset_list(small, flt, AS_OF).drop("total_count")))
    assert page == rows_sorted(whole)[flt.offset:flt.offset + flt.limit] and page
    assert assets.asset_list(small, flt, AS_OF).first()["total_count"] == len(whole)
    status = ListFilter(**{**flt.__dict__, "available": True, "assigned": True})
    lines = assets.asset_status_rows(small, status, AS_OF).orderBy("id", "rel_id").drop("rel_id").collect()
    got = assets.asset_list_by_status(small, status, AS_OF).collect()
    want = [tuple(r) for r in lines][status.offset:status.offset + status.limit]
    assert sorted((tuple(r)[1:] for r in got), key=repr) == sorted(want, key=repr)
    assert {r["total_count"] for r in got} == {len(lines)}


def rows_sorted(found):
    return sorted(found, key=lambda r: r[0])


@pytest.mark.parametrize("flt", [ListFilter(limit=7, page=2), ListFilter(name="1", deleted=True, not_an_employee=True),
                                 ListFilter(employee_id="16", name="zz", deleted=True),
                                 ListFilter(asset_types=("sim",), limit=5, page=1)])
def test_employee_pages_are_slices_of_the_whole(small, flt):
    whole = rows_sorted(rows(employees.employee_rows(small, flt)))
    got = employees.employee_list(small, flt)
    assert rows_sorted(rows(got.drop("total_count"))) == whole[flt.offset:flt.offset + flt.limit]
    assert {r["total_count"] for r in got.collect()} <= {len(whole)}


def test_strict_employee_detail_all_ids(spark, small):
    ids = small.employee.select("id")
    out = employees.employee_detail(small, ListFilter(), ids=ids, strict=True)
    listed = employees.employee_rows(small, ListFilter(), strict=True)
    hist = assets.asset_history(small).join(listed.select(F.col("id").alias("e")),
                                             F.col("employee_id") == F.col("e"), "left_semi")
    with_hist = listed.join(hist.select("employee_id").distinct(), F.col("id") == F.col("employee_id"), "left_anti")
    # one row per history entry of a listed employee, plus one row per listed employee without any
    assert out.count() == hist.count() + with_hist.count()
