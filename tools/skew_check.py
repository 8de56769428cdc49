"""Measure task balance with one hot key holding a third of the rows.

Usage: python tools/skew_check.py [sf_dir] > SKEW.md

Derives a skewed copy of the inventory tables from the test tables: every third relation row
is moved to one asset (and one employee), and a reassign batch sends every third request to
that asset.  Runs operators next to naive per-key window formulations, with Spark's event log
written to a fresh scratch folder, and reports per job the largest task's records against the
median task's (shuffle records read, reduce-side stages only).
"""
import glob
import io
import json
import os
import statistics
import sys
import tempfile
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fleetbook.functions.filters import ListFilter  # noqa: E402
from fleetbook.operators import access, asset_writes, assets, employees  # noqa: E402
from fleetbook.plans.session import SESSION_CONF, ensure_checkpoint_dir  # noqa: E402
from fleetbook.sources.fixtures import AS_OF, materialize  # noqa: E402
from fleetbook.sources.tables import load_tables, write_snapshot  # noqa: E402

HOT_ASSET, HOT_EMP = 2, 3


def skewed(spark, base):
    t = load_tables(spark, base)
    rel = t.relation.withColumn("asset_id", F.when(F.col("id") % 3 == 0, F.lit(HOT_ASSET)).otherwise(F.col("asset_id"))) \
                    .withColumn("employee_id", F.when(F.col("id") % 3 == 1, F.lit(HOT_EMP)).otherwise(F.col("employee_id")))
    return t.with_(relation=rel)


def reassign_requests(t):
    r = t.relation.select(
        F.col("id").alias("seq"), F.lit(AS_OF).cast("timestamp").alias("req_ts"), F.lit(1).cast("long").alias("actor_id"),
        F.when(F.col("id") % 3 == 0, F.lit(HOT_ASSET)).otherwise(F.col("asset_id")).alias("asset_id"),
        (F.col("employee_id") % 97 + 1).alias("employee_id"), F.lit(AS_OF.date()).alias("retrieved_date"),
        F.lit("moved").alias("retrieval_reason"), F.lit("1997-06-16").alias("assigned_date"))
    return r


def naive_holder(t):
    rel, emp = t.relation, t.employee.select(F.col("id").alias("e_id"), F.col("archived_at").alias("e_arch"))
    j = rel.join(emp, rel["employee_id"] == emp["e_id"], "left").filter(F.col("e_arch").isNull())
    w = Window.partitionBy("asset_id").orderBy(F.col("retrieved_date").desc_nulls_first(), "id")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1")


def naive_chain(req):
    w = Window.partitionBy("asset_id").orderBy("seq")
    return req.withColumn("n", F.lead(F.struct("retrieved_date", "retrieval_reason", "req_ts")).over(w))


def read_events(folder):
    events = []
    for f in sorted(glob.glob(f"{folder}/*/events_*")) + sorted(glob.glob(f"{folder}/*/*.zstd")):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        events += [json.loads(line) for line in raw.decode().splitlines() if line]
    return events


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logs = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    b = (SparkSession.builder.master("local[8]").appName("fleetbook-skew")
         .config("spark.sql.shuffle.partitions", "32").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", logs))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    # keep every shuffle partition a task, so a hot partition is visible (small data would
    # otherwise be coalesced into one task)
    b = b.config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = f"{ensure_checkpoint_dir(spark)}/skew-{uuid.uuid4().hex}"
    materialize(spark, sf, f"{root}/base")
    write_snapshot(skewed(spark, f"{root}/base"), f"{root}/skewed")
    t = load_tables(spark, f"{root}/skewed")
    req = reassign_requests(t)
    runs = {
        "R1 asset_list (visibility counts + page holders)": lambda: assets.asset_list(t, ListFilter(), AS_OF),
        "R1 naive: row_number over partitionBy(asset)": lambda: naive_holder(t),
        "R9 employee_list (page-sized counts)": lambda: employees.employee_list(t, ListFilter()),
        "R19 latest_open_session (max_by per user)": lambda: access.latest_open_session(t),
        "W5 reassign (bucketed chain)": lambda: asset_writes.reassign_assets(t, req).tables["employee_asset_relation"],
        "W5 naive: lead over partitionBy(asset)": lambda: naive_chain(req),
    }
    for name, make in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        make().write.format("noop").mode("overwrite").save()
    spark.stop()

    events = read_events(logs)
    stage_job = {}
    for e in events:
        if e["Event"] == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                stage_job[s] = group
    per_stage = {}
    for e in events:
        if e["Event"] != "SparkListenerTaskEnd" or "Task Metrics" not in e:
            continue
        m = e["Task Metrics"]
        if "Shuffle Read Metrics" not in m:
            continue
        recs = m["Shuffle Read Metrics"].get("Total Records Read", 0)
        per_stage.setdefault(e["Stage ID"], []).append((recs, e["Task Info"]["Finish Time"] - e["Task Info"]["Launch Time"]))
    print("# Skew check\n")
    print(f"Tables derived from `{sf}`; every third relation row moved to asset {HOT_ASSET} (and every")
    print(f"third to employee {HOT_EMP}); the reassign batch sends every third request to asset {HOT_ASSET}.")
    print("Per operator: the reduce stage with the most skewed tasks (largest task's shuffle records /")
    print("median task's), 32 shuffle partitions, partition coalescing off.\n")
    print("| operator | stages | worst stage: tasks | max task records | median task records | max/median | max task ms |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in runs:
        stages = [s for s, g in stage_job.items() if g == name and s in per_stage and len(per_stage[s]) > 1]
        worst, ratio = None, 0.0
        for s in stages:
            recs = [r for r, _ in per_stage[s]]
            med = statistics.median(recs) or 1
            if max(recs) / med > ratio and max(recs) > 1000:
                worst, ratio = s, max(recs) / med
        if worst is None:
            print(f"| {name} | {len(stages)} | - | - | - | balanced | - |")
            continue
        recs = [r for r, _ in per_stage[worst]]
        ms = max(d for _, d in per_stage[worst])
        print(f"| {name} | {len(stages)} | {len(recs)} | {max(recs)} | {statistics.median(recs):.0f} | "
              f"{ratio:.1f} | {ms} |")


if __name__ == "__main__":
    main()
