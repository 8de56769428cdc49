"""Unique values inside one batch: the batch result equals applying the requests one by one."""
import random

from fleetbook.operators import people_writes
from fleetbook.plans.claims import _met, _timelines, refusals
from fleetbook.plans.scan import WHOLE
from fleetbook.plans.session import cut_lineage
from helpers import TS, rows, tables

CASES = 150
USER_REQ = "seq long, req_ts timestamp, id long, name string, email string, phone_no string, password string, password_hash string"
HOUR = TS(1997, 1, 1)


def _users(rng, base, n):
    return [dict(id=base + i, name="n", email=f"m{base + i}@x.io", phone_no=f"{base + i:010d}", password="old", type="authorized",
                 status="white_listed", archived_at=HOUR if rng.random() < 0.2 else None) for i in range(1, n + 1)]


def _requests(rng, base, n, count):
    out = []
    for j in range(count):
        who = base + rng.randint(1, n + 1)                   # the last one does not exist
        mail = rng.choice([who, who, base + rng.randint(1, n)])
        out.append(dict(seq=base * 100 + j, req_ts=HOUR, id=who, name=f"r{j}",
                        email=rng.choice([f"m{mail}@x.io", f"s{base + rng.randint(1, 3)}@x.io", "bad" if rng.random() < 0.3 else f"m{mail}@x.io"]),
                        phone_no=f"{rng.choice([who, base + rng.randint(1, n + 2)]):010d}", password="secret",
                        password_hash=rng.choice(["h1", "h2", "h3", "" if rng.random() < 0.3 else "h4"])))
    rng.shuffle(out)
    return out


def _why(q, state, me):
    if "@" not in q["email"]:
        return "Invalid Email"
    if not q["password_hash"]:
        return "Invalid PasswordHash"
    if me is not None and (me not in state or state[me]["archived_at"] is not None):
        return None
    others = [u for k, u in state.items() if k != me]
    live = [u for u in others if u["archived_at"] is None]
    if me is None and any(u["email"] == q["email"] and u["phone_no"] == q["phone_no"] for u in live):
        return "user already exists"
    if any(u["email"] == q["email"] for u in others):
        return "email already used"
    if any(u["phone_no"] == q["phone_no"] for u in live):
        return "phone already used"
    return None


def _compare(spark, operator, update):
    rng = random.Random(29 if update else 31)
    users, reqs = [], []
    for k in range(CASES):
        base = (k + 1) * 100
        users += _users(rng, base, 4)
        reqs += _requests(rng, base, 4, rng.randint(2, 7))
    state, bad = {u["id"]: dict(u) for u in users}, []
    for q in sorted(reqs, key=lambda r: r["seq"]):
        me = q["id"] if update else None
        why = _why(q, state, me)
        if why:
            bad.append((q["seq"], why))
        elif not update or (me in state and state[me]["archived_at"] is None):
            new = dict(name=q["name"], email=q["email"], phone_no=q["phone_no"], password=q["password_hash"])
            state[me if update else ("new", q["seq"])] = {**(state[me] if update else {"archived_at": None}), **new}
    t = tables(spark, users=users)
    ch = operator(t, spark.createDataFrame(reqs, USER_REQ))
    assert rows(ch.rejects, "seq", "reason") == sorted(bad, key=repr)
    assert rows(ch.tables["users"], "name", "email", "phone_no", "password") == sorted(
        ((u["name"], u["email"], u["phone_no"], u["password"]) for u in state.values()), key=repr)
    assert {"email already used", "phone already used"} <= {why for _, why in bad}


def test_user_updates_equal_one_by_one(spark):
    _compare(spark, people_writes.update_users, True)


def test_user_registrations_equal_one_by_one(spark):
    _compare(spark, people_writes.register_users, False)


def test_employee_updates_equal_one_by_one(spark):
    rng = random.Random(37)
    emps, reqs = [], []
    for k in range(CASES):
        base = (k + 1) * 100
        emps += [dict(id=base + i, name="n", email=f"m{base + i}@x.io", phone_no="1234567890", status="active", type="intern",
                      archived_at=HOUR if rng.random() < 0.2 else None) for i in range(1, 5)]
        for j in range(rng.randint(2, 7)):
            reqs.append(dict(seq=base * 100 + j, req_ts=HOUR, id=base + rng.randint(1, 5), name=f"r{j}", phone_no="1234567890",
                             email=f"{rng.choice('ms')}{base + rng.randint(1, 4)}@x.io", type="intern", status="active"))
    state, bad = {e["id"]: dict(e) for e in emps}, []
    for q in sorted(reqs, key=lambda r: r["seq"]):
        e = state.get(q["id"])
        if e is None or e["archived_at"] is not None:
            continue
        if any(o["email"] == q["email"] for k, o in state.items() if k != q["id"]):
            bad.append((q["seq"], "email already used"))
        else:
            e.update(name=q["name"], email=q["email"])
    req = spark.createDataFrame(reqs, "seq long, req_ts timestamp, id long, name string, email string, phone_no string, type string, status string")
    ch = people_writes.update_employees(tables(spark, employee=emps), req)
    assert rows(ch.rejects, "seq", "reason") == sorted(bad, key=repr)
    assert rows(ch.tables["employee"], "id", "name", "email") == sorted(((e["id"], e["name"], e["email"]) for e in state.values()), key=repr)


CLAIM, HELD = "seq long, owner string, kind string, value string", "kind string, value string, owner string"


def _one_by_one(claims, held):
    holds, out = {o: v for _, v, o in held}, []
    for seq, owner, kind, value in sorted(claims):
        if any(v == value for o, v in holds.items() if o != owner):
            out.append((seq, kind))
        else:
            holds[owner] = value
    return sorted(out, key=repr)


def test_narrow_buckets_meet_the_same_holders(spark):
    """One round over scans in buckets of seven places equals one over whole keys."""
    rng = random.Random(41)
    held = spark.createDataFrame([("k", "hot", "o1"), ("k", "v2", "o2")], HELD)
    claims = [(s, f"o{rng.choice([1, 1, 1, rng.randint(2, 9)])}", "k", rng.choice(["hot", "hot", f"v{rng.randint(1, 6)}"])) for s in range(-20, 60)]
    lines = cut_lineage(_timelines(spark.createDataFrame(claims, CLAIM), held))
    asked = lines.filter("fought and not sure").select("seq", "owner", "kind", "value")
    assert rows(_met(lines, asked, 7)) == rows(_met(lines, asked, WHOLE)) != []


def test_one_row_that_keeps_its_value_decides_all_at_once(spark):
    """A third of the requests keep one value, the others want it: two rounds, not one per request."""
    held = [("k", "hot", "o1")]
    claims = [(s, "o1" if s % 3 == 0 else f"o{s}", "k", "hot") for s in range(2, 300)]
    got = refusals(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(held, HELD))
    assert rows(got) == _one_by_one(claims, held)


def test_chain_of_values_that_are_passed_on(spark):
    """Everyone takes the value of the next one, who has just left it; the first leaves for a new one."""
    held = [("k", f"v{i}", f"o{i}") for i in range(4)]
    claims = [(0, "o0", "k", "new")] + [(i, f"o{i}", "k", f"v{i - 1}") for i in range(1, 4)]
    got = refusals(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(held, HELD))
    assert rows(got) == [] == _one_by_one(claims, held)
    blocked = [(-1, "o9", "k", "new")] + claims
    got = refusals(spark.createDataFrame(blocked, CLAIM), spark.createDataFrame(held, HELD))
    assert rows(got) == _one_by_one(blocked, held) == [(i, "k") for i in range(4)]


def test_empty_batch(spark):
    got = refusals(spark.createDataFrame([], CLAIM), spark.createDataFrame([], HELD))
    assert rows(got) == []


def test_whole_values_are_shuffled_once_per_round(spark):
    """Owners' scans move the lines once, values' scans the moments once; asked claims are found among them without a join."""
    lines = spark.range(9).selectExpr("id as seq", "cast(id % 3 as string) as owner", "'email' as kind", "cast(id % 2 as string) as value",
                                      "true as fought", "id < 4 as sure")
    met = _met(lines, lines.filter("not sure").select("seq", "owner", "kind", "value"), WHOLE)
    plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(") == 2 and "Join" not in plan
