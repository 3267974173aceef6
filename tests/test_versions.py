"""Versions of closing snapshots."""

import tempfile

from ledgerlens.sources import versions as V


def test_latest_version_counts_and_earlier_ones_stay(spark):
    path = tempfile.mkdtemp(prefix="ll-test-", dir="/tmp") + "/closings"
    put = lambda *rows: V.append(spark.createDataFrame([(u, p, r, q) for u, p, r, q in rows], "unit string, period string, ref string, qty int"), path)
    assert put(("a", "2024-12", "x", 1), ("b", "2024-12", "x", 5)) == 1
    assert put(("a", "2025-01", "x", 2)) == 2
    assert put(("a", "2024-12", "y", 3)) == 3  # a's December again: x is gone
    read = lambda df: sorted((r.unit, r.period, r.ref, r.qty) for r in df.collect())
    assert read(V.as_of(spark, path)) == [("a", "2024-12", "y", 3), ("a", "2025-01", "x", 2), ("b", "2024-12", "x", 5)]
    assert read(V.as_of(spark, path, 2)) == [("a", "2024-12", "x", 1), ("a", "2025-01", "x", 2), ("b", "2024-12", "x", 5)]
    assert read(V.openings(spark, path)) == [("a", "2025-01", "y", 3), ("a", "2025-02", "x", 2), ("b", "2025-01", "x", 5)]
