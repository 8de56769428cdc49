"""Request stream: a re-run epoch is applied once; versions chain across epochs."""
import uuid

from pyspark.sql import functions as F

from fleetbook.operators import asset_writes
from fleetbook.plans.session import ensure_checkpoint_dir
from fleetbook.sources.tables import load_tables, write_snapshot
from fleetbook.streaming.request_stream import apply_micro_batch, current_tables
from helpers import D, TS, rows, tables


def test_rerun_epoch_is_applied_once(spark):
    root = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    t = tables(spark, assets=[dict(id=1, brand="B", model="M", serial_no="S", asset_type="laptop",
                                   purchased_date=D(1995, 1, 1), warranty_start_date=D(1995, 1, 1),
                                   warranty_expiry_date=D(1999, 1, 1), status="assigned", is_available=False)],
               employee=[dict(id=e, name="n", email=f"e{e}@x.io", phone_no="1", status="active")
                         for e in (1, 2, 3)],
               relation=[dict(id=10, employee_id=1, asset_id=1, assigned_date=D(1996, 1, 1))])
    write_snapshot(t, f"{root}/base")
    schema = ("seq long, req_ts timestamp, actor_id long, asset_id long, employee_id long, "
              "retrieved_date date, retrieval_reason string, assigned_date string")
    first = spark.createDataFrame([(1, TS(1997, 1, 1), 9, 1, 2, D(1997, 1, 1), "a", "1997-01-02")], schema)
    second = spark.createDataFrame([(2, TS(1997, 2, 1), 9, 1, 3, D(1997, 2, 1), "b", "1997-02-02")], schema)
    assert apply_micro_batch(first, 0, asset_writes.reassign_assets, f"{root}/base", f"{root}/out")
    assert not apply_micro_batch(first, 0, asset_writes.reassign_assets, f"{root}/base", f"{root}/out")
    assert apply_micro_batch(second, 1, asset_writes.reassign_assets, f"{root}/base", f"{root}/out")
    rel = current_tables(spark, f"{root}/base", f"{root}/out").relation
    assert rows(rel, "employee_id", "retrieved_date", "retrieval_reason", "archived_at") == [
        (1, D(1997, 1, 1), "a", TS(1997, 1, 1)), (2, D(1997, 2, 1), "b", TS(1997, 2, 1)), (3, None, None, None)]
    base = load_tables(spark, f"{root}/base")
    assert base.relation.count() == 1  # the base version is never modified
    assert rel.filter(F.col("retrieved_date").isNull()).count() == 1


def test_operations_share_a_root_and_bad_lines_are_kept(spark):
    """Two operations both count from epoch 0; malformed lines are rejects; a broken log is an error."""
    import pytest

    from fleetbook.streaming import request_stream as rs
    root = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    t = tables(spark, assets=[dict(id=1, brand="B", model="M", serial_no="S", asset_type="laptop",
                                   purchased_date=D(1995, 1, 1), warranty_start_date=D(1995, 1, 1),
                                   warranty_expiry_date=D(1999, 1, 1), status="available", is_available=True)],
               employee=[dict(id=1, name="n", email="e@x.io", phone_no="1", status="active")])
    write_snapshot(t, f"{root}/base")
    one = spark.createDataFrame([(1, TS(1997, 1, 1), 9, 1, D(2000, 1, 1), D(2001, 1, 1))],
                                "seq long, req_ts timestamp, actor_id long, asset_id long, warranty_start_date date, warranty_expiry_date date")
    two = spark.createDataFrame([(1, TS(1997, 1, 1), 9, 1, 1, "1997-01-02", None), (None, None, None, None, None, None, "{oops")],
                                "seq long, req_ts timestamp, actor_id long, asset_id long, employee_id long, assigned_date string, _corrupt_record string")
    args = (f"{root}/base", f"{root}/out")
    assert apply_micro_batch(one, 0, asset_writes.update_warranty, *args, "update_warranty")
    assert apply_micro_batch(two, 0, asset_writes.assign_assets, *args, "assign_assets")
    assert not apply_micro_batch(two, 0, asset_writes.assign_assets, *args, "assign_assets")
    now = current_tables(spark, *args)
    assert now.relation.count() == 1
    assert rows(now.assets, "warranty_expiry_date") == [(D(2001, 1, 1),)]
    assert rows(rs.rejects(spark, f"{root}/out"), "operation", "reason", "line") == [("assign_assets", rs.MALFORMED, "{oops")]
    # only a missing log counts as empty
    assert rs.store.read_log(spark, f"{root}/nowhere") is None
    with pytest.raises(Exception):
        rs.store.read_log(spark, "nosuchscheme://x/y")


def _stock(spark, n=40):
    """Assets 1..n, each assigned to employee 1."""
    return tables(
        spark, assets=[dict(id=i, brand="B", model="M", serial_no=f"S{i}", asset_type="laptop", purchased_date=D(1995, 1, 1),
                            warranty_start_date=D(1995, 1, 1), warranty_expiry_date=D(1999, 1, 1), status="assigned",
                            is_available=False) for i in range(1, n + 1)],
        employee=[dict(id=e, name="n", email=f"e{e}@x.io", phone_no="1", status="active") for e in (1, 2, 3)],
        relation=[dict(id=100 + i, employee_id=1, asset_id=i, assigned_date=D(1996, 1, 1)) for i in range(1, n + 1)])


WARRANTY = "seq long, req_ts timestamp, actor_id long, asset_id long, warranty_start_date date, warranty_expiry_date date"


def _warranty(spark, asset, year):
    return spark.createDataFrame([(1, TS(1997, 1, 1), 9, asset, D(2000, 1, 1), D(year, 1, 1))], WARRANTY)


def test_a_new_checkpoint_is_a_new_stream(spark):
    """Two streams of one operation both start at epoch 0; neither swallows the other's requests."""
    from fleetbook.sources.requests import write_requests
    from fleetbook.streaming.request_stream import apply_request_stream, stream_id
    root = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    write_snapshot(_stock(spark, 4), f"{root}/base")
    for k, year in ((1, 2001), (2, 2002)):
        write_requests(_warranty(spark, k, year), f"{root}/requests-{k}", "update_warranty")
        for _ in range(2):      # the second start finds nothing new
            apply_request_stream(spark, "update_warranty", asset_writes.update_warranty, f"{root}/requests-{k}", f"{root}/base",
                                 f"{root}/out", f"{root}/checkpoint-{k}", buckets=4).awaitTermination()
    assert stream_id(spark, f"{root}/checkpoint-1") != stream_id(spark, f"{root}/checkpoint-2")
    now = current_tables(spark, f"{root}/base", f"{root}/out").assets.filter("id <= 2")
    assert rows(now, "id", "warranty_expiry_date") == [(1, D(2001, 1, 1)), (2, D(2002, 1, 1))]


def test_starts_again_after_a_failed_first_commit(spark):
    """A log folder without rows counts as no commit."""
    from fleetbook.streaming import request_stream as rs
    root = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    write_snapshot(_stock(spark, 4), f"{root}/base")
    spark.createDataFrame([], rs.store.VERSION_SCHEMA).write.json(f"{root}/out/{rs.store.VERSIONS}")
    assert rs.rejects(spark, f"{root}/out").count() == 0
    assert current_tables(spark, f"{root}/base", f"{root}/out").assets.count() == 4
    assert apply_micro_batch(_warranty(spark, 1, 2003), 0, asset_writes.update_warranty, f"{root}/base", f"{root}/out", "update_warranty")
    assert rs.rejects(spark, f"{root}/out").count() == 0
    assert current_tables(spark, f"{root}/base", f"{root}/out").assets.filter("warranty_expiry_date = '2003-01-01'").count() == 1


def test_only_touched_buckets_are_written(spark):
    """A request for one asset writes one bucket, a registration adds rows, logins add sessions."""
    from functools import partial

    from fleetbook.operators import login
    from fleetbook.streaming import request_stream as rs
    root = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    t = _stock(spark).with_(users=tables(spark, users=[
        dict(id=i, name="u", email=f"u{i}@x.io", phone_no=str(i), type="authorized", authentication_times=0, status="white_listed")
        for i in range(1, 31)]).users)
    write_snapshot(t, f"{root}/base")
    args = (f"{root}/base", f"{root}/out")
    move = spark.createDataFrame([(1, TS(1997, 1, 1), 9, 7, 2, D(1997, 1, 1), "a", "1997-01-02")],
                                 "seq long, req_ts timestamp, actor_id long, asset_id long, employee_id long, "
                                 "retrieved_date date, retrieval_reason string, assigned_date string")
    attempts = spark.createDataFrame([(1, TS(1997, 1, 1), "u5@x.io", True), (2, TS(1997, 1, 2), "u5@x.io", True)],
                                     "seq long, ts timestamp, email string, password_ok boolean")
    assert apply_micro_batch(move, 0, asset_writes.reassign_assets, *args, "reassign_assets", "a", buckets=16)
    assert apply_micro_batch(_warranty(spark, 9, 2004), 0, asset_writes.update_warranty, *args, "update_warranty", "b")
    assert apply_micro_batch(attempts, 0, partial(login.login_outcomes, company_domain="x.io"), *args, "login_attempts", "c")
    log = rs.store.read_log(spark, args[1]).filter("stream <> 'base' and action in ('replace', 'add')")
    assert rows(log.groupBy("stream", "name", "action").count()) == [
        ("a", "assets", "replace", 1), ("a", "employee_asset_relation", "replace", 1), ("b", "assets", "replace", 1),
        ("c", "sessions", "add", 1), ("c", "users", "replace", 1)]
    now = current_tables(spark, *args)
    assert now.assets.count() == 40 and now.relation.count() == 41 and now.sessions.count() == 2 and now.users.count() == 30
    assert rows(now.relation.filter("asset_id = 7 and retrieved_date is null"), "employee_id") == [(2,)]
    # buckets hold a part of the table, and an added bucket is replaced together with what was added
    sizes = [spark.read.parquet(r["path"]).count() for r in log.filter("name = 'assets'").collect()]
    assert max(sizes) < 20
    out = spark.createDataFrame([(1, TS(1997, 2, 1), 9, 5)], "seq long, req_ts timestamp, actor_id long, user_id long")
    from fleetbook.operators import people_writes
    assert apply_micro_batch(out, 0, people_writes.logout_users, *args, "logout_users", "d")
    assert rows(current_tables(spark, *args).sessions, "user_id", "end_time") == [(5, TS(1997, 2, 1))] * 2


def test_footprints_cover_what_operators_change(spark):
    """Micro-batches through the store equal the operators applied to whole tables."""
    from fleetbook.operators import people_writes as pw
    root = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    t = _stock(spark)
    write_snapshot(t, f"{root}/base")
    base = load_tables(spark, f"{root}/base")
    common = "seq long, req_ts timestamp, actor_id long, "
    batches = [
        ("delete_assets", asset_writes.delete_assets, spark.createDataFrame(
            [(i, TS(1997, 1, 1), 9, i, "laptop", "old") for i in (3, 4, 99)], common + "id long, asset_type string, delete_reason string")),
        ("retrieve_assets", asset_writes.retrieve_assets, spark.createDataFrame(
            [(i, TS(1997, 1, 1), 9, 1, i, D(1997, 1, 2), "r") for i in (5, 6, 6, 77)],
            common + "employee_id long, asset_id long, retrieved_date date, retrieval_reason string")),
        ("upsert_employees", pw.upsert_employees, spark.createDataFrame(
            [(1, TS(1997, 1, 1), 9, "New", "employee", "new@x.io", "1234567890"), (2, TS(1997, 1, 1), 9, "Old", "employee", "e1@x.io", "1234567890")],
            common + "name string, type string, email string, phone_no string")),
        ("delete_employees", pw.delete_employees, spark.createDataFrame(
            [(1, TS(1997, 1, 1), 9, 1, "x"), (2, TS(1997, 1, 1), 9, 3, "x")], common + "employee_id long, archive_reason string")),
    ]
    now = base
    for k, (op, run, req) in enumerate(batches):
        want = run(now, req)
        now = now.with_(**{("relation" if n == "employee_asset_relation" else n): df for n, df in want.tables.items()
                           if n in ("assets", "employee_asset_relation", "employee")})
        assert apply_micro_batch(req, k, run, f"{root}/base", f"{root}/out", op, f"s{k}", buckets=8)
    got = current_tables(spark, f"{root}/base", f"{root}/out")
    for attr in ("assets", "relation", "employee"):
        assert rows(getattr(got, attr)) == rows(getattr(now, attr))


def _reassigned(spark, tmp_path, buckets):
    t = tables(spark, assets=[dict(id=a, brand="B", model="M", serial_no="S", asset_type="laptop", purchased_date=D(1995, 1, 1),
                                   warranty_start_date=D(1995, 1, 1), warranty_expiry_date=D(1999, 1, 1), status="assigned", is_available=False)
                              for a in (1, 2)],
               employee=[dict(id=e, name="n", email=f"e{e}@x.io", phone_no="1", status="active") for e in (1, 2)],
               relation=[dict(id=a * 10, employee_id=1, asset_id=a, assigned_date=D(1996, 1, 1)) for a in (1, 2)])
    write_snapshot(t, f"{tmp_path}/base")
    schema = ("seq long, req_ts timestamp, actor_id long, asset_id long, employee_id long, "
              "retrieved_date date, retrieval_reason string, assigned_date string")
    spark.createDataFrame([(1, TS(1997, 1, 1), 9, 1, 2, D(1997, 1, 1), "a", "1997-01-02")], schema).write.json(f"{tmp_path}/requests")
    batch, read = spark.read.schema(schema).json(f"{tmp_path}/requests"), []

    def operator(now, requests):
        read.extend(requests.inputFiles())
        return asset_writes.reassign_assets(now, requests)

    args = (f"{tmp_path}/base", f"{tmp_path}/out")
    assert apply_micro_batch(batch, 0, operator, *args, "reassign_assets", buckets=buckets)
    assert rows(current_tables(spark, *args).relation, "employee_id", "asset_id", "retrieved_date") == [
        (1, 1, D(1997, 1, 1)), (1, 2, None), (2, 1, None)]
    return read


def test_request_lines_are_parsed_once(spark, tmp_path):
    read = _reassigned(spark, tmp_path, 2)
    assert read and not [f for f in read if "/requests/" in f]
    assert (tmp_path / "out" / "base" / "employee_asset_relation").exists()      # one of two buckets is replaced


def test_a_table_replaced_as_a_whole_is_not_copied_before(spark, tmp_path):
    _reassigned(spark, tmp_path, 1)
    assert not (tmp_path / "out" / "base").exists()
