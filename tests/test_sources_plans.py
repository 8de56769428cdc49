"""Sources/sinks round trips and physical-plan shape checks."""
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetbook.functions.filters import ListFilter
from fleetbook.operators import access, assets, dashboard, employees
from fleetbook.sources.fixtures import AS_OF, materialize
from fleetbook.sources.requests import read_requests, write_requests
from fleetbook.sources.sinks import append_rows, camel, write_report
from fleetbook.sources.tables import ADDED_TABLES, load_tables, write_snapshot
from helpers import D, TS, rows, tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")     # whole lists of pushed filters in plans
    return materialize(spark, SF_SMALL, str(tmp_path_factory.mktemp("tables") / "v1"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_requests_keeps_bad_lines_apart(spark, tmp_path):
    d = tmp_path / "req"
    d.mkdir()
    (d / "part-0.json").write_text(
        json.dumps({"seq": 1, "reqTs": "1997-01-01T00:00:00", "actorId": 9, "assetId": 4,
                    "employeeId": 5, "retrievedDate": "1997-01-02", "retrievalReason": "x",
                    "assignedDate": "1997-01-03"}) + "\n{not json\n")
    good, bad = read_requests(spark, str(d), "reassign_assets")
    assert rows(good, "seq", "asset_id", "assigned_date") == [(1, 4, "1997-01-03")]
    assert bad.count() == 1


def test_request_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, TS(1997, 1, 1), 2, 3)], "seq long, req_ts timestamp, actor_id long, user_id long")
    write_requests(df, str(tmp_path / "out"), "logout_users")
    good, bad = read_requests(spark, str(tmp_path / "out"), "logout_users")
    assert rows(good, "seq", "req_ts", "actor_id", "user_id") == [(1, TS(1997, 1, 1), 2, 3)]
    assert bad.count() == 0


def test_report_uses_service_field_names(spark, small, tmp_path):
    page = assets.asset_list(small, ListFilter(limit=3), AS_OF)
    write_report(page, str(tmp_path / "rep"))
    line = json.loads(open(next(p for p in (tmp_path / "rep").iterdir()
                                if p.name.startswith("part-") and p.stat().st_size > 0)).readline())
    assert {"totalCount", "serialNo", "AssetType", "assignedToID", "warrantyExpiryDate"} <= set(line)
    assert camel("imei_1") == "imei1"


def test_append_rows(spark, small):
    extra = small.sessions.limit(2).select("id", "user_id")
    assert append_rows(small.sessions, extra).count() == small.sessions.count() + 2


def test_no_single_partition_exchange_over_data(stored):
    for df in (assets.asset_list(stored, ListFilter(limit=5), AS_OF),
               assets.asset_list_by_status(stored, ListFilter(available=True), AS_OF),
               employees.employee_list(stored, ListFilter()),
               access.access_report(stored, "authorized")):
        lines = _plan(df).split("\n")
        # one task only ever sees aggregated rows
        for above, below in zip(lines, lines[1:]):
            if "SinglePartition" in above:
                assert "Aggregate" in below, below
        assert "TakeOrderedAndProject" not in "".join(lines) and "GlobalLimit" not in "".join(lines)


def test_filters_and_columns_reach_the_scan(stored):
    df = assets.asset_list(stored, ListFilter(asset_types=("laptop",)), AS_OF)
    plan = _plan(df)
    assert "IsNull(archived_at)" in plan
    assert "In(asset_type" in plan or "EqualTo(asset_type" in plan
    assert "client_name" not in plan.split("ReadSchema")[1].split("\n")[0] if "ReadSchema" in plan else True


def test_no_python_in_operator_plans(stored):
    for df in (assets.asset_list(stored, ListFilter(), AS_OF), dashboard.dashboard(stored, "distributed"),
               employees.employee_list(stored, ListFilter(name="1"))):
        plan = _plan(df)
        assert "EvalPython" not in plan and "PythonUDF" not in plan


def test_no_explicit_broadcasts(stored):
    for df in (assets.asset_list(stored, ListFilter(), AS_OF), employees.employee_list(stored, ListFilter()),
               assets.asset_list_by_status(stored, ListFilter(available=True), AS_OF)):
        assert "broadcast" not in df._jdf.queryExecution().analyzed().toString().lower()


def test_pages_of_any_depth_and_skewed_keys(spark):
    from fleetbook.plans.paging import page_rows
    ids = list(range(50)) + [10 ** 12 + i for i in range(30)] + [10 ** 18 + 7 * i for i in range(9)]
    df = spark.createDataFrame([(i, f"r{i}") for i in ids], "id long, name string").repartition(5)
    text = spark.createDataFrame([(f"k{i:03}", i) for i in range(120)], "id string, name long").repartition(5)
    for offset, limit in ((0, 10), (45, 20), (78, 5), (88, 10), (89, 5), (3_000_000_000, 10), (0, 3_000_000_000), (5, 0)):
        got = sorted(r["id"] for r in page_rows(df, ["id"], offset, limit).collect())
        assert got == ids[offset:offset + limit]
        got = sorted(r["id"] for r in page_rows(text, ["id"], offset, limit).collect())
        assert got == [f"k{i:03}" for i in range(120)][offset:offset + limit]
    assert page_rows(df.filter("false"), ["id"], 0, 10).collect() == []


def _odd_ids(kind, n=900):
    """Small ids beside 64-bit hashed ones and single outliers; strings that share long prefixes."""
    import random
    rng = random.Random(kind)
    small = list(range(1, n))
    if kind == "outlier":
        return small + [2 ** 62 + 5]
    if kind == "hashed":
        return small + [rng.randint(-2 ** 63, 2 ** 63 - 1) for _ in range(n)] + [2 ** 63 - 1, -2 ** 63]
    if kind == "crowded":      # two dense runs far apart, in one digit of the whole range each
        return small + [2 ** 61 + i for i in range(n)]
    return [f"asset-2024-{i:05}" for i in small] + [f"asset-2024-00100{c}" for c in "abc\u00e9"] + ["z", "asset-2024-"]


@pytest.mark.parametrize("kind", ["outlier", "hashed", "crowded", "prefixed"])
def test_selection_counts_digits_not_rows(spark, monkeypatch, kind):
    """Whatever the ids are, no count is over more than DIGITS digits and every page is exact."""
    from fleetbook.plans import paging
    ids = sorted(_odd_ids(kind), key=lambda x: x.encode() if isinstance(x, str) else x)
    df = spark.createDataFrame([(i, 1) for i in ids], f"id {'string' if kind == 'prefixed' else 'long'}, n int").repartition(5)
    bits = 8 if kind == "prefixed" else 4
    monkeypatch.setattr(paging, "DIGIT_BITS", bits)
    monkeypatch.setattr(paging, "DIGITS", 1 << bits)
    counted = []
    narrowed = paging._narrowed

    def spy(keys, key, part, whole, ranks):
        rows = keys.filter((F.col(key) >= F.lit(part.low)) & (F.col(key) <= F.lit(part.high)))
        by = F.col(key) if part.keys <= paging.DIGITS else paging.digit(key, keys.schema[key].dataType, part.low, part.high)
        counted.append(rows.select(by.alias("d")).distinct().count())
        return narrowed(keys, key, part, whole, ranks)

    monkeypatch.setattr(paging, "_narrowed", spy)
    for offset, limit in ((450, 10), (len(ids) - 3, 10)):
        got = sorted((r["id"] for r in paging.page_rows(df, ["id"], offset, limit).collect()),
                     key=lambda x: x.encode() if isinstance(x, str) else x)
        assert got == ids[offset:offset + limit]
    assert max(counted) <= (1 << bits) + 1, counted


def test_page_bounds_reach_the_scans(stored):
    """Every table that a page reads is given the page's range of ids."""
    for df, tables in ((assets.asset_list(stored, ListFilter(limit=5, page=2), AS_OF), 2),
                       (assets.asset_list_by_status(stored, ListFilter(available=True, limit=5, page=2), AS_OF), 2),
                       (employees.employee_list(stored, ListFilter(limit=5, page=2)), 2)):
        pushed = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in line]
        bounded = [line for line in pushed if "GreaterThanOrEqual(" in line and "LessThanOrEqual(" in line]
        assert len(bounded) >= tables, pushed


def test_pages_inside_hot_assets(spark):
    """The status list's pages cut through an asset that holds most relations."""
    from helpers import tables
    from helpers import D
    t = tables(spark, assets=[dict(id=i, brand="B", model="M", serial_no=f"S{i}", asset_type="sim", purchased_date=D(1995, 1, 1),
                                   warranty_start_date=D(1995, 1, 1), warranty_expiry_date=D(1999, 1, 1), status="available",
                                   is_available=True) for i in (1, 2, -7, 10 ** 17)],
               relation=[dict(id=(k * 7919) % 1009, employee_id=1, asset_id=2, assigned_date=D(1996, 1, 1)) for k in range(40)]
               + [dict(id=5000, employee_id=1, asset_id=10 ** 17, assigned_date=D(1996, 1, 1))],
               employee=[dict(id=1, name="n", email="e@x.io", phone_no="1", status="active")])
    total = 1 + 1 + 40 + 1
    seen = []
    for page in range(9):
        got = assets.asset_list_by_status(t, ListFilter(available=True, limit=6, page=page), AS_OF).collect()
        assert len(got) == max(0, min(6, total - 6 * page)) and all(r["total_count"] == total for r in got)
        seen += [r["id"] for r in got]
    assert sorted(seen) == sorted([-7, 1, *[2] * 40, 10 ** 17])


def test_guards_read_only_the_batch(stored):
    """The relation table is reduced to the asked ids before it is shuffled."""
    ids = stored.assets.filter("id < 5").select("id")
    for df in (assets.open_counts_by_asset(stored, ids), employees.open_counts_by_employee(stored, ids)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftSemi") == 2, plan


def test_bucketed_tables_avoid_shuffles(spark, stored):
    from fleetbook.sources.catalog_tables import load_bucketed, save_bucketed
    save_bucketed(stored, "fleetbook_test", 8)
    b = load_bucketed(spark, "fleetbook_test")
    vis = assets.visibility(b)
    plan = vis._jdf.queryExecution().executedPlan().toString()
    # relation is read hash-partitioned by asset_id: the per-asset aggregate needs no exchange
    assert "Exchange hashpartitioning(asset_id" not in plan, plan
    flat = assets.visibility(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(asset_id" in flat
    # same results either way
    assert rows(assets.asset_list(b, ListFilter(limit=20), AS_OF)) == rows(
        assets.asset_list(stored, ListFilter(limit=20), AS_OF))


def test_no_cross_joins(spark, stored):
    from fleetbook.operators import asset_writes
    from fleetbook.catalog_writes import REASSIGN_REQ, _req
    frames = [assets.asset_list(stored, ListFilter(), AS_OF),
              assets.asset_list_by_status(stored, ListFilter(available=True, limit=5), AS_OF),
              employees.employee_list(stored, ListFilter(asset_types=("laptop",))),
              employees.employee_detail(stored, ListFilter(), employee_id="3"),
              dashboard.dashboard(stored, "distributed"), dashboard.dashboard(stored, "total"),
              asset_writes.reassign_assets(stored, _req(spark, stored, REASSIGN_REQ)).tables["employee_asset_relation"]]
    for df in frames:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in plan and "Cross" not in plan, plan
        assert "BroadcastNestedLoopJoin" not in plan, plan


def test_older_snapshots_load_as_if_migrated(spark, tmp_path):
    """Absent columns take the default they were added with, stored NULLs and values stay."""
    t = tables(spark, users=[{"id": 1, "name": "n", "email": "e", "phone_no": "p", "status": "block_listed"},
                             {"id": 2, "name": "m", "email": "f", "phone_no": "q", "type": "blocked"}],
               employee=[{"id": 5, "name": "a", "email": "b", "phone_no": "c", "status": "deleted"}],
               assets=[{"id": 7, "brand": "b", "model": "m", "serial_no": "s", "asset_type": "laptop", "purchased_date": D(2020, 1, 1),
                        "warranty_start_date": D(2020, 1, 1), "warranty_expiry_date": D(2021, 1, 1), "is_available": False}])
    whole = t.by_name()
    later = {"users": ["image"], "employee": [], "assets": ["status", "owned_by"]}
    write_snapshot({n: df.drop(*later.get(n, [])) for n, df in whole.items() if n not in ADDED_TABLES}, str(tmp_path / "v7"))
    u = load_tables(spark, str(tmp_path / "v7"))
    assert rows(u.users, "id", "type", "status", "image") == [(1, None, "black_listed", None), (2, "blocked", None, None)]
    assert rows(u.assets, "is_available", "status", "owned_by") == [(False, "available", None)]
    assert rows(u.employee, "status") == [("deleted",)]
    assert u.sim.count() == 0 and u.mobile.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_tables(spark, str(tmp_path / "nothing"))


def test_append_repeated_batch_changes_nothing(spark, tmp_path):
    from fleetbook.sources.sinks import append_to_table, read_appended
    path, make = str(tmp_path / "t"), lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    append_to_table(make(1, 2), path, 1)
    append_to_table(make(3), path, 2)
    append_to_table(make(1, 2), path, 1)
    assert sorted(r["id"] for r in read_appended(spark, path, make(1).schema).collect()) == [1, 2, 3]
