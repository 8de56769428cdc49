"""List filters: the parameter object of the list reports and the URL-column parser (F1)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.functions.predicates import TRUE_SPELLINGS

DEFAULT_LIMIT = 10

# Spellings accepted by the strict boolean parser of ``pagination``.
BOOL_TRUE = ("1", "t", "T", "TRUE", "true", "True")
BOOL_FALSE = ("0", "f", "F", "FALSE", "false", "False")

_INT_RE = r"^[+-]?[0-9]+$"
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
INT64_MIN, INT64_MAX = -(2 ** 63), 2 ** 63 - 1


@dataclass(frozen=True)
class ListFilter:
    """Parsed query parameters of the list reports (defaults = parameter absent)."""

    name: str = ""
    limit: int = DEFAULT_LIMIT
    page: int = 0
    pagination: bool = True
    available: bool = False
    assigned: bool = False
    deleted: bool = False
    not_an_employee: bool = False
    asset_types: tuple[str, ...] = field(default_factory=tuple)
    warranty: int = 0
    is_expired: bool = False
    employee_id: str = ""

    @property
    def is_searched(self) -> bool:
        return self.name != ""

    @property
    def offset(self) -> int:
        return self.limit * self.page

    @staticmethod
    def from_query(query: str) -> "ListFilter":
        """Parse one query string the way the list endpoints do (first value of a key wins)."""
        values: dict[str, str] = {}
        for pair in query.split("&"):
            if not pair:
                continue
            k, _, v = pair.partition("=")
            if _BAD_ESCAPE.search(k) or _BAD_ESCAPE.search(v):
                continue  # a pair with a malformed escape is dropped; the others still count
            values.setdefault(unquote_plus(k), unquote_plus(v))
        get = lambda k: values.get(k, "")

        def to_int(key: str, default: int) -> int:
            raw = get(key)
            if raw == "":
                return default
            if not re.match(_INT_RE, raw) or not INT64_MIN <= int(raw) <= INT64_MAX:
                raise ValueError(f"invalid {key}: {raw!r}")
            return int(raw)

        raw_pag = get("pagination")
        if raw_pag == "":
            pagination = True
        elif raw_pag in BOOL_TRUE or raw_pag in BOOL_FALSE:
            pagination = raw_pag in BOOL_TRUE
        else:
            raise ValueError(f"invalid pagination: {raw_pag!r}")
        limit = to_int("limit", DEFAULT_LIMIT)
        warranty = to_int("warranty", 0)
        return ListFilter(
            name=get("name"), limit=limit, page=to_int("page", 0), pagination=pagination,
            available=get("available") in TRUE_SPELLINGS,
            assigned=get("assigned") in TRUE_SPELLINGS,
            deleted=get("deleted") in TRUE_SPELLINGS,
            not_an_employee=get("notAnEmployee") in TRUE_SPELLINGS,
            asset_types=tuple(get("assetType").split(",")) if get("assetType") else (),
            warranty=warranty, is_expired=get("warranty") != "" and warranty == 0,
        )


def _raw_query(url: Column) -> Column:
    """Text between the first '?' and the fragment ('' when there is none).

    Taken with a pattern rather than a URI parser, so one malformed escape elsewhere in the
    URL does not drop the whole query.
    """
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_param(url: Column, key: str) -> Column:
    """First value of ``key`` in the URL's query, decoded; '' when absent or malformed."""
    return _first_value(query_pairs(url), key)


def query_pairs(url: Column) -> Column:
    """The query's well-formed pairs, decoded: array of (key, value) in their order.

    A pair with a malformed escape in its key or value is dropped; the others still count.
    """
    pairs = F.filter(F.split(_raw_query(url), "&"), lambda p: (p != "") & ~p.rlike(_BAD_ESCAPE.pattern))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.lit(""))
    return F.transform(pairs, lambda p: F.struct(
        decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("key"),
        decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))


def _first_value(pairs: Column, key: str) -> Column:
    hit = F.filter(pairs, lambda p: p["key"] == key)
    return F.coalesce(F.get(hit, 0)["value"], F.lit(""))


def _int_or_null(raw: Column) -> Column:
    ok = raw.rlike(_INT_RE)
    return F.when(ok, raw.try_cast("bigint"))


def parse_filters(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the parsed filter columns of ``url_col`` to every row (F1, whole column at once).

    Adds: name, limit, page, pagination, available, assigned, deleted, not_an_employee,
    asset_types (array), warranty, is_expired, filter_error (first failing parameter, or NULL).
    """
    columns = df.columns
    df = df.withColumn("__pairs", query_pairs(F.col(url_col)))
    p = {k: _first_value(F.col("__pairs"), k) for k in ("name", "limit", "page", "pagination", "available",
                                     "assigned", "deleted", "notAnEmployee", "assetType",
                                     "warranty")}
    limit_i, page_i, warranty_i = (_int_or_null(p[k]) for k in ("limit", "page", "warranty"))
    limit_bad = (p["limit"] != "") & limit_i.isNull()
    pag_bad = (p["pagination"] != "") & ~p["pagination"].isin(*BOOL_TRUE, *BOOL_FALSE)
    warranty_bad = (p["warranty"] != "") & warranty_i.isNull()
    page_bad = (p["page"] != "") & page_i.isNull()
    error = (F.when(limit_bad, F.lit("limit")).when(pag_bad, F.lit("pagination"))
             .when(warranty_bad, F.lit("warranty")).when(page_bad, F.lit("page")))
    return df.select(
        *columns,
        p["name"].alias("name"),
        F.when(p["limit"] == "", F.lit(DEFAULT_LIMIT).cast("bigint")).otherwise(limit_i).alias("limit"),
        F.when(p["page"] == "", F.lit(0).cast("bigint")).otherwise(page_i).alias("page"),
        F.when(p["pagination"] == "", F.lit(True))
         .otherwise(p["pagination"].isin(*BOOL_TRUE)).alias("pagination"),
        p["available"].isin(*TRUE_SPELLINGS).alias("available"),
        p["assigned"].isin(*TRUE_SPELLINGS).alias("assigned"),
        p["deleted"].isin(*TRUE_SPELLINGS).alias("deleted"),
        p["notAnEmployee"].isin(*TRUE_SPELLINGS).alias("not_an_employee"),
        F.when(p["assetType"] == "", F.array().cast("array<string>"))
         .otherwise(F.split(p["assetType"], ",", -1)).alias("asset_types"),
        F.when(p["warranty"] == "", F.lit(0).cast("bigint")).otherwise(warranty_i).alias("warranty"),
        ((p["warranty"] != "") & (warranty_i == 0)).alias("is_expired"),
        error.alias("filter_error"),
    )
