"""The inventory tables of a stream: bucketed folders and a commit log.

A table that no commit has changed is read from the base snapshot.  Before its first change it is copied
into ``buckets`` buckets of its key (``catalog_tables.BUCKET_KEYS``), each a folder of its own, unless
that change replaces every bucket.  A commit replaces the buckets it touched, or adds rows to them, and becomes visible
all at once when its rows are appended to the ``_versions`` log.  A bucket is the folder that replaced
it last and the folders added since.  A commit is known by (stream, epoch): ``stream`` is the id
that Spark keeps with a stream's checkpoint, so a retried epoch commits once and a stream with
a new checkpoint is never taken for an old one.  Streams that share a store take turns (one writer
at a time); versions are numbered in commit order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.sources.catalog_tables import BUCKET_KEYS
from fleetbook.sources.tables import TABLE_TO_ATTR, Tables, load_tables

VERSIONS = "_versions"
VERSION_SCHEMA = "version long, stream string, operation string, epoch long, name string, action string, bucket int, path string"
BASE = "base"
#: What a log row says: a commit, a table's bucket replaced or added to, an output that is no table.
COMMIT, REPLACE, ADD, OUTPUT = "commit", "replace", "add", "output"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_log(spark: SparkSession, out_root: str) -> DataFrame | None:
    """The commit log; None only where no log exists yet (any other failure is raised)."""
    try:
        return spark.read.schema(VERSION_SCHEMA).json(f"{out_root}/{VERSIONS}")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_version(log: DataFrame | None) -> int:
    """The highest version; -1 for no log or one without rows."""
    top = None if log is None else log.agg(F.max("version")).first()[0]
    return -1 if top is None else top


def append_log(spark: SparkSession, out_root: str, rows: list[tuple]) -> None:
    """The commit point: all rows of a commit are one file."""
    spark.createDataFrame(rows, VERSION_SCHEMA).coalesce(1).write.mode("append").json(f"{out_root}/{VERSIONS}")


def write_buckets(df: DataFrame, key: str, buckets: int, path: str) -> list[int]:
    """Write ``df`` as ``path/bucket=n`` folders; returns the buckets that got rows.

    Rebalanced by bucket: small buckets share tasks, and a bucket that holds a hot key is split.
    """
    placed = df.withColumn("bucket", bucket_of(F.col(key), buckets))
    placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = [f.getPath().getName() for f in listed]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


class BucketStore:
    """The store under ``out_root``, over the snapshot at ``base_dir``."""

    def __init__(self, spark: SparkSession, base_dir: str, out_root: str, buckets: int = 64):
        self.spark, self.out_root = spark, out_root
        self.base = load_tables(spark, base_dir).by_name()
        log = read_log(spark, out_root)
        made = None if log is None else log.filter((F.col("stream") == BASE) & (F.col("action") == COMMIT)).first()
        self.buckets = buckets if made is None else made["bucket"]          # as the store was made
        if made is None:
            append_log(spark, out_root, [(0, BASE, BASE, 0, VERSIONS, COMMIT, buckets, base_dir)])
        self.reload()

    def reload(self) -> None:
        """Read which folders make up each bucket now (a bounded list: tables x buckets, and added folders)."""
        log = read_log(self.spark, self.out_root).filter(F.col("action").isin(REPLACE, ADD))
        last = log.filter(F.col("action") == REPLACE).groupBy(F.col("name").alias("__n"), F.col("bucket").alias("__b")).agg(
            F.max("version").alias("__v"))
        live = log.join(last, (F.col("name") == F.col("__n")) & (F.col("bucket") == F.col("__b")), "left").filter(
            F.col("__v").isNull() | (F.col("version") > F.col("__v")) | ((F.col("version") == F.col("__v")) & (F.col("action") == REPLACE)))
        self.paths: dict[str, dict[int, list[str]]] = {}
        for row in live.select("name", "bucket", "path").collect():
            held = self.paths.setdefault(row["name"], {}).setdefault(row["bucket"], [])
            if row["path"]:
                held.append(row["path"])

    def bucketed(self, name: str) -> None:
        """Copy a table into buckets, once, before its first change.  A copy changes nothing, so it is a
        commit of its own; all buckets are listed, the empty ones without a folder."""
        if name in self.paths:
            return
        path = f"{self.out_root}/base/{name}"
        held = set(write_buckets(self.base[name], BUCKET_KEYS[name], self.buckets, path))
        self.paths[name] = {b: [f"{path}/bucket={b}"] if b in held else [] for b in range(self.buckets)}
        append_log(self.spark, self.out_root, [(0, BASE, BASE, 0, name, REPLACE, b, (p or [""])[0]) for b, p in self.paths[name].items()])

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        if name not in self.paths:
            df = self.base[name]
            return df if buckets is None else df.filter(bucket_of(F.col(BUCKET_KEYS[name]), self.buckets).isin(*buckets))
        held = self.paths[name]
        paths = [p for b in (held if buckets is None else buckets) for p in held.get(b, [])]
        if not paths:
            return self.spark.createDataFrame([], self.base[name].schema)
        return self.spark.read.schema(self.base[name].schema).parquet(*paths)

    def tables(self, only: dict[str, list[int]] | None = None) -> Tables:
        """All tables; of those named in ``only`` just the given buckets."""
        only = only or {}
        return Tables(**{TABLE_TO_ATTR[name]: self.table(name, only.get(name)) for name in self.base})

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the one-column ``keys`` (at most ``buckets`` numbers)."""
        placed = keys.select(bucket_of(F.col(keys.columns[0]), self.buckets).alias("b")).filter("b is not null")
        return sorted(r["b"] for r in placed.distinct().collect())
