"""Every registered query against its DuckDB oracle on the smallest fixture (sf0.001)."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tools.check_oracle import TABLES, norm, type_mismatches

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle_or_is_listed():
    # the optional corpus operators are tested against brute force where SQL cannot express them
    assert {q for q in set(QUERIES) - set(ORACLES) if not q.startswith("op") and q != "pipeline"} == set()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["total_count", "id"]
    assert 0 < df.count() <= 10


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    got = [tuple(norm(x) for x in r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert type_mismatches(df, cur) == []
    want = [tuple(norm(x) for x in r) for r in cur.fetchall()]
    assert sorted(cols) == sorted(ocols)
    order = sorted(cols)
    g = sorted((tuple(r[cols.index(c)] for c in order) for r in got), key=repr)
    w = sorted((tuple(r[ocols.index(c)] for c in order) for r in want), key=repr)
    assert g == w
