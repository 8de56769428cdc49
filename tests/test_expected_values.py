"""Counts taken independently (DuckDB, by the rules) from the fixtures at sf0.001 and sf0.01."""
import pytest
from pyspark.sql import functions as F

from fleetbook.functions.filters import ListFilter
from fleetbook.functions.predicates import is_expired, within_months
from fleetbook.operators import assets, employees
from fleetbook.sources.fixtures import AS_OF, shared_tables

EXPECTED = {
    "/root/testdata/sf0.001": dict(open=100, total=190, k1=(2752, 434), k6=(10, 119, 0),
                                   k14=(21, 12), sessions=(403, 10)),
    "/root/testdata/sf0.01": dict(open=1000, total=1900, k1=(27729, 4923), k6=(101, 808, 1),
                                  k14=(219, 138), sessions=(3995, 10)),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_survey_counts(spark, sf):
    e, t = EXPECTED[sf], shared_tables(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(
        spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    assert t.relation.count() == lines.count()      # every row of the source table is a relation
    assert t.relation.filter("retrieved_date is null").count() == e["open"]
    assert assets.asset_list(t, ListFilter(), AS_OF).first()["total_count"] == e["total"]
    k1 = ListFilter(available=True, deleted=True, asset_types=("laptop",), pagination=False)
    assert (assets.asset_export(t, k1, AS_OF).count(),
            assets.asset_export(t, k1, AS_OF, strict=True).count()) == e["k1"]
    w = F.col("warranty_expiry_date")
    assert (t.assets.filter(within_months(w, 3, AS_OF)).count(), t.assets.filter(is_expired(w, AS_OF)).count(),
            t.assets.filter(w == F.lit(AS_OF.date())).count()) == e["k6"]
    k14 = ListFilter(name="1", deleted=True, not_an_employee=True)
    assert (employees.employee_rows(t, k14).count(), employees.employee_rows(t, k14, strict=True).count()) == e["k14"]
    s = t.sessions.filter("end_time is null")
    assert (s.count(), s.select("user_id").distinct().count()) == e["sessions"]
    # open relations are held by active employees only
    inactive = t.employee.filter("status <> 'active'").select(F.col("id").alias("e_id"))
    held = t.relation.filter("retrieved_date is null").join(
        inactive, F.col("employee_id") == F.col("e_id"), "left_semi")
    assert held.count() == 0
