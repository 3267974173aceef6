"""Physical-plan checks over every registered query."""

import pytest

from conftest import SF_SMALL
from ledgerlens.plans.catalog import QUERIES as CATALOG

QUERIES = {name: q.build for name, q in CATALOG.items()}
# keys whose work genuinely needs Python: per-file workbook parsing / writing
# and the per-unit greedy file assignment
PYTHON_OK = {"match_files", "match_files_words", "unmatched", "match_counts", "grid_xlsx", "export_xlsx"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_no_nested_loop_no_row_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan                      # never a row-at-a-time Python UDF
    if name not in PYTHON_OK:
        assert "ArrowEvalPython" not in plan and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("name", ["header_densest", "stock_load", "mov_stacked", "report_lines"])
def test_grid_scans_hash_aggregate_and_stream(spark, name):
    """Whole-sheet header picks are hash aggregates (no sort of the sheet),
    and per-sheet / per-group tables meet the data in broadcast joins."""
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "SortAggregate" not in plan
    assert "SortMergeJoin" not in plan


def test_checked_broadcast_follows_measured_size(spark):
    from pyspark.sql import functions as F

    from ledgerlens.session import checked_broadcast

    big = spark.range(20000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = checked_broadcast(spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("tag")), "test")
    assert "BroadcastHashJoin" in _plan(big.join(small, "k"))
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "16")                     # bytes: below the written table's size
        j = big.join(checked_broadcast(spark.range(50).select(F.col("id").alias("k")), "test"), "k")
        assert "BroadcastHashJoin" not in _plan(j)
        assert j.count() == 20000
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
