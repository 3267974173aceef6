"""Comparison semantics, equivalences and properties."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import reconcile as R
from ledgerlens.operators.rollforward import rollforward
from ledgerlens.sources import tables as T

LINES = "unit string, ref string, qty decimal(18,4)"


def test_null_and_blank_refs_and_all_null_sums(spark):
    stock = spark.createDataFrame([("u", "A", Decimal("1.005")), ("u", "A", Decimal("1")), ("u", None, Decimal(5)),
                                   ("u", "B", None)], LINES)
    mov = spark.createDataFrame([("u", "A", Decimal("2.01")), ("u", "C", Decimal("-3"))], LINES)
    got = {r["Ref"]: r for r in R.reconcile(stock, mov, keys=["unit"]).collect()}
    assert set(got) == {"A", "B", "C"}                          # NULL ref never forms a group
    assert got["A"]["Stock_Qty"] == 2.01                        # 2.005 rounds HALF_UP
    assert got["A"]["status"] == "match"
    assert got["B"]["Stock_Qty"] == 0.0                         # all-NULL group sums to 0
    assert got["C"]["Difference"] == 3.0 and got["C"]["status"] == "discrepancy"


def test_tolerance_is_inclusive(spark):
    stock = spark.createDataFrame([("u", "A", Decimal("1.02")), ("u", "B", Decimal("1.03"))], LINES)
    mov = spark.createDataFrame([("u", "A", Decimal("1.00")), ("u", "B", Decimal("1.00"))], LINES)
    got = {r["Ref"]: r["status"] for r in R.reconcile(stock, mov, ["unit"], tolerance=0.02).collect()}
    assert got == {"A": "match", "B": "discrepancy"}


def test_join_equals_union(spark):
    s, m = T.stock_lines(spark, SF_SMALL), T.mov_lines(spark, SF_SMALL)
    a, b = R.reconcile_join(s, m), R.reconcile_union(s, m)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_properties(spark):
    s, m = T.stock_lines(spark, SF_SMALL), T.mov_lines(spark, SF_SMALL)
    r = R.reconcile(s, m)
    tot = r.agg(F.sum("Stock_Qty"), F.sum("Calc_Mov_Qty"), F.sum("Difference")).first()
    assert abs(tot[0] - tot[1] - tot[2]) < 1e-6
    matches, disc = R.split(r)
    n_refs = m.select("ref").union(s.select("ref")).where("ref is not null").distinct().count()
    assert matches.count() + disc.count() == n_refs
    assert matches.join(disc, "Ref").count() == 0


def test_partition_count_does_not_change_results(spark):
    s, m = T.stock_lines(spark, SF_SMALL), T.mov_lines(spark, SF_SMALL)
    a = R.reconcile(s.repartition(3), m.repartition(7))
    b = R.reconcile(s.coalesce(1), m.coalesce(1))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rollforward_without_opening(spark):
    closing = spark.createDataFrame([("u", "A", Decimal(10)), ("u", "B", Decimal(4))], LINES)
    mov = spark.createDataFrame([("u", "A", Decimal("9.99")), ("u", "C", Decimal(1))], LINES)
    opening = spark.createDataFrame([("u", "B", Decimal(4))], LINES)
    got = {r["Ref"]: r for r in rollforward(closing, mov, opening, keys=("unit",)).collect()}
    assert got["A"]["status"] == "match" and got["A"]["Difference"] == 0.01
    assert got["B"]["Calc_Mov_Qty"] == 4.0 and got["B"]["status"] == "match"
    assert got["C"]["Stock_Qty"] == 0.0 and got["C"]["status"] == "discrepancy"
    none = {r["Ref"]: r for r in rollforward(closing, mov, None, keys=("unit",)).collect()}
    assert none["B"]["status"] == "discrepancy"


@pytest.mark.parametrize("name", ["reconcile_exact", "reconcile_union", "offset_pairs", "report_lines",
                                  "disc_order_signed", "stock_load", "mov_stacked", "csv_sniff"])
def test_plans_have_no_cartesian_or_python(spark, name):
    import __spark_entry__ as E
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_filters_reach_the_scan(spark):
    import __spark_entry__ as E
    plan = E.queries()["cutoff_cumulative"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate,1998-07-01" in plan                    # cutoff pushed into the scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
