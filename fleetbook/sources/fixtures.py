"""Inventory tables derived deterministically from the driver's test tables.

The SQL below runs unchanged on Spark and on DuckDB (the oracle): ``{name}`` placeholders
are bound to DataFrames on Spark (``spark.sql(text, name=df)``) and to the pre-registered
view names on DuckDB.  The relations alone have a form of their own on Spark (``derive_relation``), with
the same rows.  Test-time "now" is ``AS_OF``; session time zone UTC.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetbook.sources.schemas import table_schema
from fleetbook.sources.tables import ATTR_TO_TABLE, TABLE_TO_ATTR, Tables, conform, load_table, load_tables, write_snapshot

AS_OF = dt.datetime(1997, 6, 15, 12, 0, 0)
# Ids of assets that no relation and no specification mentions start here.
SPARE_ASSETS = 10_000_000
ARCHIVED = "timestamp '1997-01-01 00:00:00'"

# Derived views: name -> (SQL template, source tables it reads).
FIXTURE_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "users": (f"""
select s_suppkey as id, s_name as name,
  concat('user', cast(s_suppkey as string), '@', case when s_suppkey % 5 = 4 then 'other.org' else 'example.com' end) as email,
  lpad(cast(s_suppkey as string), 10, '9') as phone_no,
  case s_suppkey % 4 when 0 then 'unauthorized' when 1 then 'blocked' else 'authorized' end as type,
  case when s_suppkey % 8 = 0 then 0 when s_suppkey % 4 = 0 then 1 when s_suppkey % 4 = 1 then 2 else 0 end as authentication_times,
  case when s_suppkey % 8 = 4 then 'warned' when s_suppkey % 4 = 1 then 'black_listed' else 'white_listed' end as status,
  case when s_suppkey % 3 = 0 then cast(null as string) else concat('img/', cast(s_suppkey as string)) end as image,
  case when s_suppkey % 10 = 9 then {ARCHIVED} else cast(null as timestamp) end as archived_at
from {{supplier}}""", ("supplier",)),
    "employee": (f"""
select c_custkey as id, c_name as name, concat('emp', cast(c_custkey as string), '@example.com') as email,
  lpad(cast(c_custkey as string), 10, '8') as phone_no,
  case c_custkey % 10 when 7 then 'deleted' when 8 then 'not_an_employee' else 'active' end as status,
  case c_nationkey % 3 when 0 then 'employee' when 1 then 'intern' else 'freelancer' end as type,
  case when c_custkey % 10 = 7 then {ARCHIVED} else cast(null as timestamp) end as archived_at,
  case when c_custkey % 10 = 7 then 'left' else cast(null as string) end as archive_reason,
  case when c_custkey % 10 = 7 then cast(0 as bigint) else cast(null as bigint) end as deleted_by
from {{customer}}""", ("customer",)),
    "assets": (f"""
select p_partkey as id, p_brand as brand, p_type as model, concat('SN', cast(p_partkey as string)) as serial_no,
  case p_size % 6 when 0 then 'laptop' when 1 then 'mouse' when 2 then 'pen drive' when 3 then 'hard disk' when 4 then 'mobile' else 'sim' end as asset_type,
  date '1994-01-01' + cast(p_partkey % 700 as int) as purchased_date,
  date '1994-01-01' + cast(p_partkey % 700 as int) as warranty_start_date,
  date '1994-01-01' + cast(p_partkey % 700 + 365 * (1 + p_size % 5) as int) as warranty_expiry_date,
  case when p_partkey % 20 = 19 then 'deleted' when p_partkey % 2 = 0 then 'assigned' else 'available' end as status,
  p_partkey % 2 = 1 as is_available,
  case when p_partkey % 3 = 0 then 'client' else 'remote_state' end as owned_by,
  case when p_partkey % 3 = 0 then concat('client', cast(p_partkey % 7 as string)) else '' end as client_name,
  case when p_partkey % 20 = 19 then {ARCHIVED} else cast(null as timestamp) end as archived_at,
  case when p_partkey % 20 = 19 then 'broken' else cast(null as string) end as archive_reason,
  case when p_partkey % 20 = 19 then cast(0 as bigint) else cast(null as bigint) end as deleted_by
from (select p_partkey, p_brand, p_type, p_size from {{part}}
  union all select p_partkey + {SPARE_ASSETS}, p_brand, p_type, p_size from {{part}} where p_partkey % 50 = 3) p""", ("part",)),
    "employee_asset_relation": ("""
select l_orderkey * 100 + n as id,
  case when l_partkey % 50 = 1 then cast(7 as bigint) when is_open and o_custkey % 10 in (7, 8) then o_custkey - 2 else o_custkey end as employee_id,
  l_partkey as asset_id, l_suppkey as assigned_by, cast(o_orderdate as date) as assigned_date,
  case when is_open then cast(null as date) else cast(l_shipdate as date) end as retrieved_date,
  case when is_open or l_returnflag = 'N' then cast(null as string) when l_returnflag = 'R' then 'returned' else 'replaced' end as retrieval_reason,
  case when not is_open and l_returnflag = 'A' then cast(l_shipdate as timestamp) else cast(null as timestamp) end as archived_at
from (select *, (r = 1 and l_partkey % 2 = 0) as is_open from (
  select *,
    row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, l_extendedprice desc) as r,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as n
  from {lineitem}) x) y
join {orders} on l_orderkey = o_orderkey""", ("lineitem", "orders")),
    "laptop_specifications": (f"""
select p_partkey as asset_id, p_type as series, concat('cpu', cast(p_size % 4 as string)) as processor,
  concat(cast(8 * (1 + p_size % 4) as string), 'GB') as ram, 'linux' as operating_system, p_size % 4 < 2 as charger,
  '1920x1080' as screen_resolution, concat(cast(256 * (1 + p_size % 3) as string), 'GB') as storage,
  case when p_partkey % 20 = 19 then {ARCHIVED} else cast(null as timestamp) end as archived_at
from {{part}} where p_size % 6 = 0""", ("part",)),
    "pen_drive_specifications": (f"""
select p_partkey as asset_id, concat(cast(16 * (1 + p_size % 4) as string), 'GB') as storage,
  case when p_partkey % 20 = 19 then {ARCHIVED} else cast(null as timestamp) end as archived_at
from {{part}} where p_size % 6 = 2""", ("part",)),
    "hard_disk_specifications": (f"""
select p_partkey as asset_id, concat(cast(1 + p_size % 4 as string), 'TB') as storage,
  case when p_partkey % 20 = 19 then {ARCHIVED} else cast(null as timestamp) end as archived_at
from {{part}} where p_size % 6 = 3""", ("part",)),
    "mobile_specifications": (f"""
select p_partkey as asset_id, case when p_partkey % 2 = 0 then 'android' else 'ios' end as os_type,
  lpad(cast(p_partkey as string), 15, '1') as imei_1, lpad(cast(p_partkey as string), 15, '2') as imei_2,
  concat(cast(4 * (1 + p_size % 3) as string), 'GB') as ram,
  case when p_partkey % 20 = 19 then {ARCHIVED} else cast(null as timestamp) end as archived_at
from {{part}} where p_size % 6 = 4""", ("part",)),
    "sim_specifications": (f"""
select p_partkey as asset_id, concat('SIM', cast(p_partkey as string)) as sim_no, lpad(cast(p_partkey as string), 10, '7') as phone_no,
  case when p_partkey % 20 = 19 then {ARCHIVED} else cast(null as timestamp) end as archived_at
from {{part}} where p_size % 6 = 5""", ("part",)),
    "sessions": ("""
select event_id as id, user_id % 10 as user_id,
  case when event_id % 97 = 13 then cast(null as timestamp) else cast(ts as timestamp) end as start_time,
  case when event_type in ('purchase', 'error') then cast(null as timestamp) else cast(ts as timestamp) + interval '1' hour end as end_time
from {events}""", ("events",)),
}


def duckdb_ctes(names) -> str:
    """``WITH`` prefix defining the requested derived views for the DuckDB oracle."""
    wanted = [n for n in FIXTURE_SQL if n in set(names)]
    parts = []
    for n in wanted:
        text, sources = FIXTURE_SQL[n]
        parts.append(f"{n} as ({text.format(**{s: s for s in sources})}\n)")
    return "with " + ",\n".join(parts) + "\n"


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What orders a line among those of its part (latest first) and of its order.
_LATEST = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
_IN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def derive_relation(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows of ``FIXTURE_SQL["employee_asset_relation"]``, with each line shuffled once.

    Only the latest line of a part is asked for, so it is a maximum per part, reduced where the lines are
    read.  These few lines are added to all lines as marks: in the one window per order a mark
    sorts before the line it stands for (the first of equal ones), which so learns that it is open.
    """
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice"]
    lines = lineitem.select(*columns, F.lit(False).alias("mark"))
    even = F.col("l_partkey") % 2 == 0
    latest = (lineitem.filter(F.coalesce(even, F.lit(True))).groupBy("l_partkey")
              .agg(F.max(F.struct(*_LATEST)).alias("top")).select("l_partkey", "top.*")
              .select(*[c for c in columns if c != "l_returnflag"], F.lit(True).alias("mark")))
    turn = Window.partitionBy("l_orderkey").orderBy(*_IN_ORDER, F.desc("mark"))
    upto = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (lines.unionByName(latest, allowMissingColumns=True)
              .withColumns({"n": F.count(F.when(~F.col("mark"), 1)).over(upto), "marked": F.lag("mark", 1, False).over(turn)})
              .filter(~F.col("mark"))
              .withColumn("is_open", F.when(F.col("marked"), even).otherwise(F.lit(False))))
    joined = placed.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr(
        "l_orderkey * 100 + n as id",
        "case when l_partkey % 50 = 1 then cast(7 as bigint) when is_open and o_custkey % 10 in (7, 8) then o_custkey - 2 else o_custkey end as employee_id",
        "l_partkey as asset_id", "l_suppkey as assigned_by", "cast(o_orderdate as date) as assigned_date",
        "case when is_open then cast(null as date) else cast(l_shipdate as date) end as retrieved_date",
        "case when is_open or l_returnflag = 'N' then cast(null as string) when l_returnflag = 'R' then 'returned' else 'replaced' end as retrieval_reason",
        "case when not is_open and l_returnflag = 'A' then cast(l_shipdate as timestamp) else cast(null as timestamp) end as archived_at")


def derive_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, sources = FIXTURE_SQL[name]
    frames = {s: read_source(spark, sf_dir, s) for s in sources}
    df = derive_relation(**frames) if name == "employee_asset_relation" else spark.sql(text, **frames)
    return conform(df, table_schema(name))


def build_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All inventory tables derived from ``sf_dir`` (lazy; nothing is computed here)."""
    return Tables(**{TABLE_TO_ATTR[n]: derive_table(spark, sf_dir, n) for n in FIXTURE_SQL})


class DerivedTables(Tables):
    """The derived tables, each stored as a whole when it is first asked for and read from there."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, stored: dict[str, DataFrame] | None = None):
        for name, value in (("spark", spark), ("sf_dir", sf_dir), ("root", root), ("stored", {} if stored is None else stored)):
            object.__setattr__(self, name, value)

    def __getattr__(self, attr: str) -> DataFrame:
        if attr not in ATTR_TO_TABLE:
            raise AttributeError(attr)
        name, stored = ATTR_TO_TABLE[attr], self.stored
        if name not in stored:
            path = f"{self.root}/{uuid.uuid4().hex}/{name}"
            derive_table(self.spark, self.sf_dir, name).write.parquet(path)
            stored[name] = load_table(self.spark, path, name)
        return stored[name]

    def with_(self, **changes: DataFrame) -> Tables:
        """These tables with some replaced; the others are still shared."""
        other = DerivedTables(self.spark, self.sf_dir, self.root, self.stored)
        for attr, df in {**{a: v for a, v in self.__dict__.items() if a in ATTR_TO_TABLE}, **changes}.items():
            if attr not in ATTR_TO_TABLE:
                raise TypeError(f"no table {attr!r}")
            object.__setattr__(other, attr, df)
        return other


_SHARED: dict[tuple[str, str], DerivedTables] = {}


def shared_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables, each stored once per (application, folder) in the shared folder, for the
    query registry: every query then reads stored tables, as a deployment does, and a lost
    executor costs nothing but a re-read.  A query pays for the tables it uses."""
    from fleetbook.plans.session import ensure_checkpoint_dir

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED or _SHARED[key].spark is not spark:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetbook-tables-{uuid.uuid4().hex}"
        _SHARED[key] = DerivedTables(spark, sf_dir, root)
    return _SHARED[key]


def materialize(spark: SparkSession, sf_dir: str, out_dir: str) -> Tables:
    """Derive the tables once and store them as Parquet (what a deployment keeps on disk)."""
    write_snapshot(build_tables(spark, sf_dir), out_dir)
    return load_tables(spark, out_dir)
