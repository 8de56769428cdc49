"""Benchmark of the headline operators.

Derives the inventory tables from ``$BENCH_SF_DIR`` once and stores them as Parquet in a
fresh scratch folder (what a deployment keeps on disk), then times each headline operator
over those tables: one warm-up, then the median of ``$BENCH_RUNS`` runs.  Each run computes
the whole result (``noop`` sink), so nothing is collected to the driver.

Prints one JSON line: {"metric", "value" (sum of medians, sec), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetbook.catalog_writes import (ATTEMPT_SQL, COMPANY_DOMAIN, REASSIGN_REQ,  # noqa: E402
                                      _req)
from fleetbook.functions.filters import ListFilter  # noqa: E402
from fleetbook.operators import access, asset_writes, assets, dashboard, employees, login  # noqa: E402
from fleetbook.plans.session import ensure_checkpoint_dir, local_session  # noqa: E402
from fleetbook.sources.fixtures import AS_OF, materialize, read_source  # noqa: E402


def stored_requests(spark, t, sf_dir, scratch):
    """Request batches as a deployment receives them: files, read back with their schema."""
    spark.sql(ATTEMPT_SQL, events=read_source(spark, sf_dir, "events")).write.parquet(f"{scratch}/attempts")
    _req(spark, t, REASSIGN_REQ).write.parquet(f"{scratch}/reassign")
    return spark.read.parquet(f"{scratch}/attempts"), spark.read.parquet(f"{scratch}/reassign")


def headline(spark, t, attempts, reassign):
    return {
        "R1_asset_list": lambda: assets.asset_list(t, ListFilter(limit=50, page=3), AS_OF),
        "R2_status_list": lambda: assets.asset_list_by_status(
            t, ListFilter(available=True, deleted=True, asset_types=("laptop",), limit=20, page=3),
            AS_OF),
        "R3_export": lambda: assets.asset_export(
            t, ListFilter(available=True, assigned=True, deleted=True, pagination=False), AS_OF),
        "R9_employee_list": lambda: employees.employee_list(
            t, ListFilter(name="1", deleted=True, not_an_employee=True)),
        "R13_dashboard": lambda: dashboard.dashboard(t, "distributed"),
        "R14_access_report": lambda: access.access_report(t, "authorized"),
        "W5_reassign": lambda: asset_writes.reassign_assets(t, reassign).tables["employee_asset_relation"],
        "W16_login": lambda: login.login_outcomes(t, attempts, COMPANY_DOMAIN).tables["login_outcomes"],
    }


def run_once(make_df) -> float:
    t0 = time.perf_counter()
    make_df().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="fleetbook-bench")
    # scratch under the shared checkpoint folder (set by the session; on a cluster: shared storage)
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    t0 = time.perf_counter()
    t = materialize(spark, sf_dir, f"{scratch}/tables")
    fixture_sec = time.perf_counter() - t0
    rows = {"employee_asset_relation": t.relation.count(), "assets": t.assets.count(),
            "employee": t.employee.count()}
    results = {}
    attempts, reassign = stored_requests(spark, t, sf_dir, scratch)
    for name, make in headline(spark, t, attempts, reassign).items():
        run_once(make)  # warm-up
        results[name] = round(statistics.median(run_once(make) for _ in range(runs)), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_operators_median_sum", "value": round(sum(results.values()), 4),
        "unit": "sec", "queries": results, "sf": sf, "cpus": cpus, "runs": runs,
        "fixture_build_sec": round(fixture_sec, 3), "rows": rows,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
