"""A mixed log equals its requests applied one by one."""
import random

from pyspark.sql import functions as F

from fleetbook.operators.asset_log import apply_asset_log
from helpers import D, TS, rows, tables

CASES = 300
LOG = ("seq long, req_ts timestamp, actor_id long, operation string, asset_id long, employee_id long, assigned_date string, "
       "retrieved_date date, retrieval_reason string, asset_type string, delete_reason string, warranty_start_date date, "
       "warranty_expiry_date date")
ZERO = D(1, 1, 1)


def one_by_one(assets, emps, rels, specs, log):
    assets, rels, specs = {a["id"]: dict(a) for a in assets}, [dict(r) for r in rels], [dict(s) for s in specs]
    emp_ids, rejects = {e["id"] for e in emps}, []
    for q in sorted(log, key=lambda q: q["seq"]):
        op, a, e = q["operation"], q["asset_id"], q["employee_id"]
        asset = assets.get(a)
        live = asset is not None and asset.get("archived_at") is None
        if op == "assign_assets":
            if asset is None or e not in emp_ids:
                rejects.append((q["seq"], "unknown asset" if asset is None else "unknown employee"))
                continue
            rels.append(dict(employee_id=e, asset_id=a, assigned_date=D.fromisoformat(q["assigned_date"]) if q["assigned_date"] else ZERO))
            if live:
                asset.update(status="assigned", is_available=False)
        elif op == "reassign_assets":
            if not q["retrieval_reason"]:
                rejects.append((q["seq"], "Invalid RetrievalReason"))
                continue
            if asset is None or e not in emp_ids:
                rejects.append((q["seq"], "unknown asset" if asset is None else "unknown employee"))
                continue
            for r in rels:
                if r["asset_id"] == a and r.get("archived_at") is None:
                    r.update(retrieved_date=q["retrieved_date"], retrieval_reason=q["retrieval_reason"], archived_at=q["req_ts"])
            rels.append(dict(employee_id=e, asset_id=a, assigned_date=D.fromisoformat(q["assigned_date"])))
            if live:
                asset.update(status="assigned", is_available=False)
        elif op == "retrieve_assets":
            for r in rels:
                if (r["asset_id"], r["employee_id"]) == (a, e) and r.get("retrieved_date") is None:
                    r.update(retrieved_date=q["retrieved_date"] or ZERO, retrieval_reason=q["retrieval_reason"] or "")
            if live:
                asset.update(status="available", is_available=True)
        elif op == "delete_assets":
            if any(r["asset_id"] == a and r.get("retrieved_date") is None and r.get("archived_at") is None for r in rels):
                rejects.append((q["seq"], "asset is assigned"))
                continue
            if live:
                asset.update(archived_at=q["req_ts"], status="deleted", archive_reason=q["delete_reason"] or "", deleted_by=q["actor_id"])
            for s in specs:
                if s["asset_id"] == a and q["asset_type"] == "laptop" and s.get("archived_at") is None:
                    s["archived_at"] = q["req_ts"]
        elif op == "update_warranty":
            if live:
                asset.update(warranty_start_date=q["warranty_start_date"] or ZERO, warranty_expiry_date=q["warranty_expiry_date"] or ZERO)
        else:
            rejects.append((q["seq"], "unknown operation"))
    return assets.values(), rels, specs, rejects


def test_mixed_log_equals_one_by_one(spark, width=3):
    rng = random.Random(21)
    assets, emps, rels, specs, log = [], [], [], [], []
    for k in range(CASES):
        base = (k + 1) * 100
        hot = rng.random() < 0.5          # many requests for one asset
        for i in (1, 2):
            assets.append(dict(id=base + i, brand="B", model="M", serial_no="S", asset_type="laptop", purchased_date=D(1995, 1, 1),
                               warranty_start_date=D(1995, 1, 1), warranty_expiry_date=D(1999, 1, 1), status="available",
                               is_available=True, archived_at=TS(1996, 1, 1) if rng.random() < 0.1 else None))
            specs.append(dict(id=base + i, asset_id=base + i))
            emps.append(dict(id=base + i, name="n", email=f"e{base + i}@x.io", phone_no="1", status="active"))
        for j in range(rng.randint(0, 3)):
            closed, archived = rng.random() < 0.4, rng.random() < 0.3
            rels.append(dict(id=base * 10 + j, employee_id=base + rng.randint(1, 2), asset_id=base + rng.randint(1, 2),
                             assigned_date=D(1996, 1, 1), retrieved_date=D(1996, 2, 1) if closed else None,
                             archived_at=TS(1996, 2, 1) if archived else None))
        for j in range(rng.randint(2, 10)):
            op = rng.choice(["assign_assets", "reassign_assets", "retrieve_assets", "retrieve_assets", "delete_assets", "delete_assets",
                             "update_warranty", "dance"])
            log.append(dict(seq=base * 10 + j, req_ts=TS(1997, 1, 1 + j), actor_id=9, operation=op,
                            asset_id=base + (1 if hot else rng.randint(1, 3)), employee_id=base + rng.randint(1, 3),
                            assigned_date=None if op == "assign_assets" and rng.random() < 0.3 else f"1997-02-{1 + j:02}",
                            retrieved_date=None if op != "reassign_assets" and rng.random() < 0.3 else D(1997, 3, 1 + j),
                            retrieval_reason=rng.choice(["x", "y", ""]), asset_type=rng.choice(["laptop", "laptop", "mouse"]),
                            delete_reason=rng.choice([None, "old"]), warranty_start_date=rng.choice([None, D(1998, 1, 1 + j)]),
                            warranty_expiry_date=D(1999, 2, 1 + j)))
    t = tables(spark, assets=assets, employee=emps, relation=rels, laptop=specs)
    names = [f.split()[0] for f in LOG.split(", ")]
    got = apply_asset_log(t, spark.createDataFrame([tuple(q[n] for n in names) for q in log], LOG), width)
    want_assets, want_rels, want_specs, want_rejects = one_by_one(assets, emps, rels, specs, log)

    def same(df, columns, want):
        assert rows(df, *columns) == sorted((tuple(w.get(c) for c in columns) for w in want), key=repr)

    same(got.tables["employee_asset_relation"], ["employee_id", "asset_id", "assigned_date", "retrieved_date", "retrieval_reason", "archived_at"], want_rels)
    same(got.tables["assets"], ["id", "status", "is_available", "warranty_start_date", "warranty_expiry_date", "archived_at",
                                "archive_reason", "deleted_by"], want_assets)
    same(got.tables["laptop_specifications"], ["asset_id", "archived_at"], want_specs)
    assert rows(got.rejects, "seq", "reason") == sorted(want_rejects, key=repr)
    assert {r for _, r in want_rejects} >= {"asset is assigned", "unknown operation", "unknown asset", "unknown employee"}


def test_checked_requests_are_stored_before_the_scans(spark):
    """Each scan reads its input twice: it meets the checked log, not the joins that check it."""
    from fleetbook.operators.asset_log import checked_log
    ok, _ = checked_log(tables(spark), spark.createDataFrame([], LOG))
    assert "Join" not in ok._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_log_in_assets_scanned_whole(spark, monkeypatch):
    """Assets are counted: whole where none is large, else in buckets; both equal the requests one by one."""
    from fleetbook.operators import asset_log
    from fleetbook.plans.scan import WHOLE
    counted, count = [], asset_log.scan_width
    monkeypatch.setattr(asset_log, "scan_width", lambda *a: counted.append(count(*a)) or counted[-1])
    test_mixed_log_equals_one_by_one(spark, None)
    monkeypatch.setattr(asset_log, "WIDTH", 3)
    test_mixed_log_equals_one_by_one(spark, None)
    assert counted == [WHOLE, None]


def test_whole_assets_are_shuffled_once(spark):
    """All scans of the holders read rows that were dealt by asset once."""
    from fleetbook.operators.asset_log import with_holders
    from fleetbook.plans.scan import WHOLE
    held = spark.createDataFrame([], "asset_id long, employee_id long")
    plan = with_holders(spark.createDataFrame([], LOG), held, WHOLE)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 4 and "Join" not in plan
    executed = with_holders(spark.createDataFrame([], LOG).filter("seq > 0"), held, WHOLE)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(") == 1


def test_relation_without_employee_is_held_until_reassigned(spark):
    """A retrieval without employee names nobody, so it does not close a relation without employee."""
    from fleetbook.plans.scan import WHOLE
    day = D(1995, 1, 1)
    t = tables(spark, assets=[dict(id=1, brand="B", model="M", serial_no="S", asset_type="laptop", purchased_date=day, warranty_start_date=day,
                                   warranty_expiry_date=day, status="assigned", is_available=False)],
               employee=[dict(id=5, name="n", email="e@x.io", phone_no="1", status="active")],
               relation=[dict(id=1, asset_id=1, employee_id=4, assigned_date=day), dict(id=2, asset_id=1, employee_id=5, assigned_date=day)])
    t = t.with_(relation=t.relation.withColumn("employee_id", F.expr("case when employee_id = 5 then employee_id end")))
    ask = dict.fromkeys([f.split()[0] for f in LOG.split(", ")]) | dict(asset_id=1, actor_id=9, asset_type="laptop", req_ts=TS(1997, 1, 1))
    log = [dict(ask, seq=1, operation="retrieve_assets"), dict(ask, seq=2, operation="retrieve_assets", employee_id=5), dict(ask, seq=3, operation="delete_assets"),
           dict(ask, seq=4, operation="reassign_assets", employee_id=5, assigned_date="1997-02-01", retrieved_date=D(1997, 2, 1), retrieval_reason="x"),
           dict(ask, seq=5, operation="retrieve_assets", employee_id=5), dict(ask, seq=6, operation="delete_assets")]
    for width in (WHOLE, 3):
        got = apply_asset_log(t, spark.createDataFrame([tuple(q.values()) for q in log], LOG), width)
        assert rows(got.rejects, "seq", "reason") == [(3, "asset is assigned")]
        assert rows(got.tables["assets"], "status") == [("deleted",)]
