"""The URL-column filter parser agrees with the one-request parser on random query strings."""
import random

from fleetbook.functions.filters import ListFilter, parse_filters

VALUES = ["", "0", "1", "-3", "+7", "12", "x1", " 4", "true", "True", "TRUE", "t", "F", "no",
          "laptop", "laptop,sim", "sim,", "%zz", "a+b", "2147483648"]
KEYS = ["limit", "page", "pagination", "available", "assigned", "deleted", "notAnEmployee",
        "assetType", "warranty", "name"]


def _random_query(rng):
    parts = []
    for _ in range(rng.randint(0, 7)):
        parts.append(f"{rng.choice(KEYS)}={rng.choice(VALUES).replace(' ', '%20')}")
    return "&".join(parts)


def test_column_parser_matches_request_parser(spark):
    rng = random.Random(5)
    queries = [_random_query(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, f"http://h/x?{q}") for i, q in enumerate(queries)], "i int, url string")
    got = {r["i"]: r for r in parse_filters(df, "url").collect()}
    for i, q in enumerate(queries):
        r = got[i]
        try:
            want = ListFilter.from_query(q)
        except ValueError:
            assert r["filter_error"] is not None, q
            continue
        assert r["filter_error"] is None, q
        assert (r["limit"], r["page"], r["pagination"], r["warranty"], r["is_expired"]) == (
            want.limit, want.page, want.pagination, want.warranty, want.is_expired), q
        assert (r["available"], r["assigned"], r["deleted"], r["not_an_employee"]) == (
            want.available, want.assigned, want.deleted, want.not_an_employee), q
        assert tuple(r["asset_types"]) == want.asset_types, q
        assert r["name"] == want.name, q
