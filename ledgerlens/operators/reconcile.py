"""Snapshot-versus-ledger comparison (aggregate both sides, full outer compare).

Inputs are *line* DataFrames with a reference column ``ref``, a quantity
``qty`` (DECIMAL) and any number of grouping keys (unit, atelier, job_idx ...).
The output keeps the keys and adds ``Ref, Stock_Qty, Calc_Mov_Qty,
Difference, status`` where ``status`` is ``match`` or ``discrepancy``.

Two physical shapes produce the same rows:

* :func:`reconcile_join`  - aggregate each side, full outer equi-join.
* :func:`reconcile_union` - tag lines, ``unionByName``, one ``groupBy`` with
  two conditional sums.  Partial aggregation runs map-side on both inputs and
  there is a single shuffle on ``(keys, Ref)``; this is the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import QTY

MATCH, DISCREPANCY = "match", "discrepancy"
OUT_COLS = ("Ref", "Stock_Qty", "Calc_Mov_Qty", "Difference", "status")


def _line_qty(round_lines: int | None) -> Column:
    q = F.col("qty").cast(QTY)
    return F.round(q, round_lines) if round_lines is not None else q


def sum_round2(c: Column) -> Column:
    """SUM rounded HALF_UP to 2 dp; an all-NULL or empty group sums to 0."""
    return F.round(F.coalesce(F.sum(c), F.lit(0).cast(QTY)), 2)


def aggregate_side(lines: DataFrame, keys: Sequence[str] = (), out: str = "Qty",
                   round_lines: int | None = None) -> DataFrame:
    """SUM(qty) by (keys, ref) rounded to 2 dp; NULL refs never form a group."""
    return (lines.where(F.col("ref").isNotNull())
            .groupBy(*keys, F.col("ref").alias("Ref"))
            .agg(sum_round2(_line_qty(round_lines)).alias(out)))


def status_of(diff: Column, tolerance: float | None) -> Column:
    """Exact-zero rule, or inclusive absolute tolerance on decimals."""
    if tolerance is None:
        ok = diff == 0
    else:
        ok = F.abs(diff) <= F.lit(tolerance).cast(QTY)
    return F.when(ok, F.lit(MATCH)).otherwise(F.lit(DISCREPANCY))


def finish(df: DataFrame, keys: Sequence[str], tolerance: float | None = None,
           round_diff: bool = False) -> DataFrame:
    sq = F.coalesce(F.col("Stock_Qty"), F.lit(0).cast(QTY))
    mq = F.coalesce(F.col("Calc_Mov_Qty"), F.lit(0).cast(QTY))
    diff = sq - mq
    if round_diff:
        diff = F.round(diff, 2)
    return df.select(
        *keys, "Ref",
        sq.cast("double").alias("Stock_Qty"),
        mq.cast("double").alias("Calc_Mov_Qty"),
        diff.cast("double").alias("Difference"),
        status_of(diff, tolerance).alias("status"),
    )


def reconcile_join(stock: DataFrame, mov: DataFrame, keys: Sequence[str] = (),
                   tolerance: float | None = None, stock_round: int | None = None,
                   mov_round: int | None = None) -> DataFrame:
    """Aggregate both sides, then FULL OUTER JOIN on (keys, Ref)."""
    s = aggregate_side(stock, keys, "Stock_Qty", stock_round)
    m = aggregate_side(mov, keys, "Calc_Mov_Qty", mov_round)
    return finish(s.join(m, [*keys, "Ref"], "full_outer"), keys, tolerance)


def reconcile_union(stock: DataFrame, mov: DataFrame, keys: Sequence[str] = (),
                    tolerance: float | None = None, stock_round: int | None = None,
                    mov_round: int | None = None) -> DataFrame:
    """Join-free comparison: one shuffle, two filtered sums (a line touches
    the sum of its own side alone)."""
    cols = [*keys, "ref"]
    s = stock.select(*cols, _line_qty(stock_round).cast(QTY).alias("_q"), F.lit(True).alias("_stock"))
    m = mov.select(*cols, _line_qty(mov_round).cast(QTY).alias("_q"), F.lit(False).alias("_stock"))
    tagged = s.unionByName(m).where(F.col("ref").isNotNull())
    side = lambda of: F.round(F.coalesce(F.expr(f"sum(_q) filter (where {of})"), F.lit(0).cast(QTY)), 2)
    agg = (tagged.groupBy(*keys, F.col("ref").alias("Ref"))
           .agg(side("_stock").alias("Stock_Qty"), side("not _stock").alias("Calc_Mov_Qty")))
    return finish(agg, keys, tolerance)


reconcile = reconcile_union


def split(recon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, discrepancies) views of a reconciliation result."""
    return recon.where(F.col("status") == MATCH), recon.where(F.col("status") == DISCREPANCY)
