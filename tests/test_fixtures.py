"""Derived tables: the relations' own form on Spark, and tables stored one by one."""
import datetime as dt
import random

import pytest

from fleetbook.sources import fixtures
from fleetbook.sources.fixtures import FIXTURE_SQL, DerivedTables, derive_relation

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
        "l_returnflag string, l_shipdate timestamp")
ORDER = "o_orderkey long, o_custkey long, o_orderdate timestamp"


def _lines(seed: int) -> list[tuple]:
    """Lines with missing values, ties in all but one of the ordering columns, and one part in a third of them."""
    rng = random.Random(seed)
    pick = lambda *v: rng.choice([*v, None] if rng.random() < 0.2 else v)
    rows = {}
    for _ in range(400):
        key = (pick(*range(30)), pick(4, *range(12)), pick(1, 2), pick(1, 2, 3), pick(0.0, 1.5, 2.5),
               pick(dt.datetime(1996, 1, 1), dt.datetime(1996, 1, 2, 5), dt.datetime(1996, 1, 3)))
        rows[key] = (*key[:5], pick("A", "N", "R"), key[5])      # one line per key: ties have no set order
    return list(rows.values())


@pytest.mark.parametrize("seed", range(4))
def test_relations_equal_the_fixture_sql(spark, seed):
    lines = spark.createDataFrame(_lines(seed), LINE)
    orders = spark.createDataFrame([(k, 40 + k if k % 5 else None, dt.datetime(1995, 1, 1 + k % 28)) for k in range(28)], ORDER)
    want = spark.sql(FIXTURE_SQL["employee_asset_relation"][0], lineitem=lines, orders=orders).collect()
    got = derive_relation(lines, orders).select(*want[0].__fields__).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_equal_lines_leave_one_relation_open(spark):
    line = (5, 6, 1, 1, 2.0, "N", dt.datetime(1996, 1, 1))
    orders = spark.createDataFrame([(5, 11, dt.datetime(1995, 1, 1))], ORDER)
    rows = derive_relation(spark.createDataFrame([line] * 3, LINE), orders).collect()
    assert sorted(r["id"] for r in rows) == [501, 502, 503]
    assert [r["retrieved_date"] is None for r in rows].count(True) == 1


def test_each_line_is_shuffled_once(spark):
    lines, orders = spark.createDataFrame(_lines(0), LINE), spark.createDataFrame([], ORDER)
    plan = derive_relation(lines, orders)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1          # the SQL form has two, over different keys


def test_tables_are_stored_when_asked_for(spark, tmp_path, monkeypatch):
    derived = []
    derive = fixtures.derive_table
    monkeypatch.setattr(fixtures, "derive_table", lambda s, d, name: derived.append(name) or derive(s, d, name))
    t = DerivedTables(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert t.spec("mobile").count() > 0 and t.assets.count() > 0
    other = t.with_(assets=t.assets.limit(1))
    assert other.assets.count() == 1 and other.users.count() == t.users.count()
    assert derived == ["mobile_specifications", "assets", "users"]
    assert t.spec("car") is None and len(t.by_name()) == 10
    assert len(derived) == 10
    with pytest.raises(TypeError):
        t.with_(cars=t.assets)
