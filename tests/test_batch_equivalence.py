"""Batch operators equal applying the requests one by one (plain-Python interpreter).

Each test packs many random cases into one batch: case ``k`` uses ids ``k*100 + small``, so the
cases cannot interact, while inside a case a few keys receive many requests (hot keys,
repeated requests, guard hits).
"""
import random

from fleetbook.operators import asset_writes, login, people_writes
from helpers import D, TS, rows, tables

CASES = 200
ZERO = D(1, 1, 1)


def _random_relations(rng, base, n_assets, n_emps):
    rels, rid = [], base * 1000
    for _ in range(rng.randint(0, 6)):
        rid += 1
        closed = rng.random() < 0.5
        rels.append(dict(id=rid, employee_id=base + rng.randint(1, n_emps),
                         asset_id=base + rng.randint(1, n_assets), assigned_by=1,
                         assigned_date=D(1996, 1, 1),
                         retrieved_date=D(1996, 2, rng.randint(1, 28)) if closed else None,
                         retrieval_reason=rng.choice([None, "r"]) if closed else None,
                         archived_at=TS(1996, 3, 1) if closed and rng.random() < 0.5 else None))
    return rels


def _assets(base, n, rng):
    return [dict(id=base + i, brand="B", model="M", serial_no="S", asset_type=rng.choice(["laptop", "mobile"]),
                 purchased_date=D(1995, 1, 1), warranty_start_date=D(1995, 1, 1),
                 warranty_expiry_date=D(1999, 1, 1), status="available", is_available=True,
                 archived_at=TS(1996, 1, 1) if rng.random() < 0.15 else None) for i in range(1, n + 1)]


def _emps(base, n):
    return [dict(id=base + i, name="n", email=f"e{base + i}@x.io", phone_no="1234567890",
                 status="active", type="employee") for i in range(1, n + 1)]


def _rel_key(r):
    return (r["employee_id"], r["asset_id"], r["retrieved_date"], r["retrieval_reason"], r["archived_at"])


def test_reassign_chain_equals_sequential(spark):
    rng = random.Random(7)
    assets, emps, rels, reqs = [], [], [], []
    for k in range(CASES):
        base = (k + 1) * 100
        assets += _assets(base, 3, rng)
        emps += _emps(base, 3)
        rels += _random_relations(rng, base, 3, 3)
        for j in range(rng.randint(1, 6)):
            reqs.append(dict(seq=base * 100 + j, req_ts=TS(1997, 1, 1 + j), actor_id=9,
                             asset_id=base + rng.randint(1, 4),  # 4 = unknown asset
                             employee_id=base + rng.randint(1, 4),
                             retrieved_date=D(1997, 1, rng.randint(1, 28)),
                             retrieval_reason=rng.choice(["x", "y", ""]),
                             assigned_date=rng.choice(["1997-02-01", "bad"])))
    # one by one
    state = [dict(r) for r in rels]
    asset_ids = {a["id"] for a in assets}
    emp_ids = {e["id"] for e in emps}
    for q in sorted(reqs, key=lambda r: r["seq"]):
        if q["retrieval_reason"] == "" or q["assigned_date"] == "bad":
            continue
        if q["employee_id"] not in emp_ids or q["asset_id"] not in asset_ids:
            continue
        for r in state:
            if r["asset_id"] == q["asset_id"] and r["archived_at"] is None:
                r.update(retrieved_date=q["retrieved_date"], retrieval_reason=q["retrieval_reason"],
                         archived_at=q["req_ts"])
        state.append(dict(employee_id=q["employee_id"], asset_id=q["asset_id"], retrieved_date=None,
                          retrieval_reason=None, archived_at=None))
    t = tables(spark, assets=assets, employee=emps, relation=rels)
    req = spark.createDataFrame(reqs, "seq long, req_ts timestamp, actor_id long, asset_id long, "
                                      "employee_id long, retrieved_date date, retrieval_reason string, "
                                      "assigned_date string")
    got = rows(asset_writes.reassign_assets(t, req).tables["employee_asset_relation"],
               "employee_id", "asset_id", "retrieved_date", "retrieval_reason", "archived_at")
    assert got == sorted((_rel_key(r) for r in state), key=repr)


def test_retrieve_first_wins_equals_sequential(spark):
    rng = random.Random(11)
    assets, rels, reqs = [], [], []
    for k in range(CASES):
        base = (k + 1) * 100
        assets += _assets(base, 3, rng)
        rels += _random_relations(rng, base, 3, 2)
        for j in range(rng.randint(1, 5)):
            reqs.append(dict(seq=base * 100 + j, employee_id=base + rng.randint(1, 2),
                             asset_id=base + rng.randint(1, 3),
                             retrieved_date=rng.choice([None, D(1997, 5, 1 + j)]),
                             retrieval_reason=rng.choice([None, f"r{j}"])))
    state = [dict(r) for r in rels]
    for q in sorted(reqs, key=lambda r: r["seq"]):
        for r in state:
            if (r["employee_id"], r["asset_id"]) == (q["employee_id"], q["asset_id"]) and r["retrieved_date"] is None:
                r.update(retrieved_date=q["retrieved_date"] or ZERO,
                         retrieval_reason=q["retrieval_reason"] or "")
    t = tables(spark, assets=assets, relation=rels)
    req = spark.createDataFrame(reqs, "seq long, employee_id long, asset_id long, retrieved_date date, "
                                      "retrieval_reason string")
    got = rows(asset_writes.retrieve_assets(t, req).tables["employee_asset_relation"],
               "employee_id", "asset_id", "retrieved_date", "retrieval_reason", "archived_at")
    assert got == sorted((_rel_key(r) for r in state), key=repr)


def test_delete_guard_and_first_wins_equals_sequential(spark):
    rng = random.Random(13)
    assets, rels, laptops, mobiles, reqs = [], [], [], [], []
    for k in range(CASES):
        base = (k + 1) * 100
        a = _assets(base, 3, rng)
        assets += a
        rels += _random_relations(rng, base, 3, 2)
        for x in a:
            (laptops if rng.random() < 0.5 else mobiles).append(dict(id=x["id"], asset_id=x["id"]))
        for j in range(rng.randint(1, 5)):
            reqs.append(dict(seq=base * 100 + j, req_ts=TS(1997, 1, 1 + j), actor_id=9,
                             id=base + rng.randint(1, 3), asset_type=rng.choice(["laptop", "mobile", "mouse"]),
                             delete_reason=rng.choice([None, "gone"])))
    open_count = {}
    for r in rels:
        if r["retrieved_date"] is None and r["archived_at"] is None:
            open_count[r["asset_id"]] = open_count.get(r["asset_id"], 0) + 1
    st_assets = {a["id"]: dict(a) for a in assets}
    st_specs = {"laptop": [dict(s) for s in laptops], "mobile": [dict(s) for s in mobiles]}
    for q in sorted(reqs, key=lambda r: r["seq"]):
        if open_count.get(q["id"], 0) > 0:
            continue
        for s in st_specs.get(q["asset_type"], []):
            if s["asset_id"] == q["id"] and s.get("archived_at") is None:
                s["archived_at"] = q["req_ts"]
        a = st_assets.get(q["id"])
        if a and a["archived_at"] is None:
            a.update(archived_at=q["req_ts"], status="deleted", archive_reason=q["delete_reason"] or "",
                     deleted_by=9)
    t = tables(spark, assets=assets, relation=rels, laptop=laptops, mobile=mobiles)
    req = spark.createDataFrame(reqs, "seq long, req_ts timestamp, actor_id long, id long, "
                                      "asset_type string, delete_reason string")
    ch = asset_writes.delete_assets(t, req)
    got = rows(ch.tables["assets"], "id", "archived_at", "status", "archive_reason", "deleted_by")
    want = sorted(((a["id"], a["archived_at"], a["status"], a.get("archive_reason"), a.get("deleted_by"))
                   for a in st_assets.values()), key=repr)
    assert got == want
    got_l = rows(ch.tables["laptop_specifications"], "asset_id", "archived_at")
    assert got_l == sorted(((s["asset_id"], s.get("archived_at")) for s in st_specs["laptop"]), key=repr)


def test_update_employees_last_wins_with_guard(spark):
    rng = random.Random(17)
    emps, rels, reqs = [], [], []
    for k in range(CASES):
        base = (k + 1) * 100
        emps += _emps(base, 3)
        rels += _random_relations(rng, base, 2, 3)
        for j in range(rng.randint(1, 6)):
            eid = base + rng.randint(1, 3)
            reqs.append(dict(seq=base * 100 + j, req_ts=TS(1997, 1, 1 + j), id=eid, name=rng.choice(["a", "b", ""]),
                             email=f"e{eid}@x.io", phone_no="1234567890", type="intern",
                             status=rng.choice(["active", "not_an_employee", "deleted"])))
    busy = {r["employee_id"] for r in rels if r["retrieved_date"] is None and r["archived_at"] is None}
    st = {e["id"]: dict(e) for e in emps}
    for q in sorted(reqs, key=lambda r: r["seq"]):
        if q["name"] == "" or (q["status"] == "not_an_employee" and q["id"] in busy):
            continue
        e = st[q["id"]]
        e.update(name=q["name"], status=q["status"], type=q["type"], updated_at=q["req_ts"])
    t = tables(spark, employee=emps, relation=rels)
    req = spark.createDataFrame(reqs, "seq long, req_ts timestamp, id long, name string, email string, "
                                      "phone_no string, type string, status string")
    got = rows(people_writes.update_employees(t, req).tables["employee"], "id", "name", "status",
               "type", "updated_at")
    want = sorted(((e["id"], e["name"], e["status"], e["type"], e.get("updated_at")) for e in st.values()),
                  key=repr)
    assert got == want


def _policy(user, valid_attempts):
    typ, times, status = user["type"], user["authentication_times"], user["status"]
    out = []
    for _ in valid_attempts:
        if typ == "unauthorized" and times == 0:
            out.append("warned"); times += 1; status = "warned"  # noqa: E702
        elif typ == "unauthorized" and times > 0:
            out.append("blocked_now"); times += 1; typ, status = "blocked", "black_listed"  # noqa: E702
        elif typ == "blocked":
            out.append("blocked")
        else:
            out.append("session")
    return out, (typ, status, times)


def test_login_policy_equals_sequential(spark):
    rng = random.Random(19)
    users, attempts = [], []
    for k in range(CASES):
        base = (k + 1) * 100
        for i in range(1, 3):
            users.append(dict(id=base + i, name="u", email=f"u{base + i}@co.io", phone_no=str(base + i),
                              type=rng.choice(["unauthorized", "authorized", "blocked"]),
                              authentication_times=rng.choice([0, 0, 1, 3]), status="white_listed"))
        for j in range(rng.randint(1, 7)):
            attempts.append(dict(seq=base * 100 + j, ts=TS(1997, 1, 1, 0, j),
                                 email=f"u{base + rng.randint(1, 3)}@co.io", password_ok=rng.random() < 0.8))
    by_email = {u["email"]: u for u in users}
    want_out, want_state = {}, {}
    for u in users:
        mine = sorted((a for a in attempts if a["email"] == u["email"]), key=lambda a: a["seq"])
        valid = [a for a in mine if a["password_ok"]]
        outs, state = _policy(u, valid)
        want_state[u["id"]] = state
        for a, o in zip(valid, outs):
            want_out[a["seq"]] = o
        for a in mine:
            want_out.setdefault(a["seq"], "wrong_password")
    for a in attempts:
        if a["email"] not in by_email:
            want_out[a["seq"]] = "wrong_email"
    t = tables(spark, users=users)
    att = spark.createDataFrame(attempts, "seq long, ts timestamp, email string, password_ok boolean")
    ch = login.login_outcomes(t, att, "co.io")
    assert dict(rows(ch.tables["login_outcomes"], "seq", "outcome")) == want_out
    got_state = {r[0]: r[1:] for r in rows(ch.tables["users"], "id", "type", "status", "authentication_times")}
    assert got_state == want_state


def test_chain_next_equals_lead_across_buckets(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from fleetbook.plans.batch import chain_next
    rng = random.Random(23)
    data = [(rng.randint(1, 4), seq, f"p{seq}") for seq in rng.sample(range(1, 400), 150)]
    df = spark.createDataFrame(data, "k long, seq long, p string")
    want = df.withColumn("n", F.lead(F.struct("p")).over(Window.partitionBy("k").orderBy("seq")))
    for width in (1, 3, 50, 1 << 20):
        got = chain_next(df, "k", "seq", ["p"], width=width, name="n")
        assert rows(got, "k", "seq", "n") == rows(want, "k", "seq", "n")


def test_apply_in_order_chains_operations(spark):
    from fleetbook.plans.batch import apply_in_order
    t = tables(spark, assets=[dict(id=1, brand="B", model="M", serial_no="S", asset_type="laptop",
                                   purchased_date=D(1995, 1, 1), warranty_start_date=D(1995, 1, 1),
                                   warranty_expiry_date=D(1999, 1, 1), status="available", is_available=True)],
               employee=_emps(0, 2))
    assign = spark.createDataFrame([(1, TS(1997, 1, 1), 9, 1, 1, D(1997, 1, 1))],
                                   "seq long, req_ts timestamp, actor_id long, employee_id long, "
                                   "asset_id long, assigned_date date")
    retrieve = spark.createDataFrame([(2, 1, 1, D(1997, 2, 1), "done")],
                                     "seq long, employee_id long, asset_id long, retrieved_date date, "
                                     "retrieval_reason string")
    delete = spark.createDataFrame([(3, TS(1997, 3, 1), 9, 1, "laptop", "old")],
                                   "seq long, req_ts timestamp, actor_id long, id long, asset_type string, "
                                   "delete_reason string")
    out, rejects = apply_in_order(t, [(asset_writes.assign_assets, assign),
                                      (asset_writes.retrieve_assets, retrieve),
                                      (asset_writes.delete_assets, delete)])
    assert rows(out.relation, "employee_id", "retrieved_date", "retrieval_reason") == [(1, D(1997, 2, 1), "done")]
    assert rows(out.assets, "status", "archive_reason") == [("deleted", "old")]
    assert rejects.count() == 0
    # without the retrieve step the delete is rejected by the guard
    out2, rejects2 = apply_in_order(t, [(asset_writes.assign_assets, assign),
                                        (asset_writes.delete_assets, delete)], cut_every=0)
    assert rows(rejects2, "seq", "reason", "step") == [(3, "asset is assigned", 2)]
    assert rows(out2.assets, "status") == [("assigned",)]


def test_archived_relations_are_not_dealt_out_when_assets_move(spark):
    from fleetbook.operators.asset_writes import reassign_assets
    t = tables(spark, assets=[dict(id=1, brand="B", model="M", serial_no="S", asset_type="laptop", purchased_date=D(1995, 1, 1),
                                   warranty_start_date=D(1995, 1, 1), warranty_expiry_date=D(1999, 1, 1), status="assigned", is_available=False)],
               employee=[dict(id=1, name="n", email="e@x.io", phone_no="1", status="active")],
               relation=[dict(id=5, employee_id=1, asset_id=1, assigned_date=D(1995, 2, 1), archived_at=TS(1996, 1, 1)),
                         dict(id=6, employee_id=1, asset_id=1, assigned_date=D(1996, 2, 1))])
    req = spark.createDataFrame([(1, TS(1997, 1, 1), 9, 1, 1, D(1997, 1, 1), "a", "1997-01-02")],
                                "seq long, req_ts timestamp, actor_id long, asset_id long, employee_id long, "
                                "retrieved_date date, retrieval_reason string, assigned_date string")
    out = reassign_assets(t, req).tables["employee_asset_relation"]
    assert rows(out, "archived_at", "retrieved_date") == [
        (None, None), (TS(1996, 1, 1), None), (TS(1997, 1, 1), D(1997, 1, 1))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter isnotnull(archived_at" in plan       # the archived ones are a branch without a join
