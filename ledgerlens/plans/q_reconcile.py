"""Registered queries: aggregation, comparison, cutoffs, rounding, tolerance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import reconcile as R
from ledgerlens.operators.cutoff import cumulative_cutoff, exact_month
from ledgerlens.operators.locations import implicit_selection
from ledgerlens.operators.locations import location_in as loc_in
from ledgerlens.operators.locations import location_pair_in as pair_in
from ledgerlens.plans import sql_adapters as S
from ledgerlens.plans.registry import cte, query
from ledgerlens.sources import tables as T

_RECON_SQL = (cte(mov_lines=S.MOV_LINES, stock_lines=S.STOCK_LINES,
                  s=S.side_agg("stock_lines", "Stock_Qty"),
                  m=S.side_agg("mov_lines", "Calc_Mov_Qty"))
              + S.recon_select(S.full_join("s", "m")))


@query("reconcile_exact", _RECON_SQL)
def reconcile_exact(spark, sf_dir):
    """Stock vs movement by Ref, full outer join, exact-zero match."""
    return R.reconcile_join(T.stock_lines(spark, sf_dir), T.mov_lines(spark, sf_dir))


@query("reconcile_union", _RECON_SQL)
def reconcile_union(spark, sf_dir):
    """The same rows from one union + one conditional-sum aggregate."""
    return R.reconcile_union(T.stock_lines(spark, sf_dir), T.mov_lines(spark, sf_dir))


@query("mov_agg", cte(mov_lines=S.MOV_LINES)
       + "SELECT ref AS Ref, CAST(ROUND(COALESCE(SUM(qty), 0), 2) AS DOUBLE) AS Calc_Mov_Qty "
         "FROM mov_lines WHERE ref IS NOT NULL GROUP BY ref")
def mov_agg(spark, sf_dir):
    """A1: movement SUM(qty) by Ref, rounded to 2 dp."""
    out = R.aggregate_side(T.mov_lines(spark, sf_dir), out="Calc_Mov_Qty")
    return out.select("Ref", F.col("Calc_Mov_Qty").cast("double").alias("Calc_Mov_Qty"))


@query("stock_agg", cte(mov_lines=S.MOV_LINES, stock_lines=S.STOCK_LINES)
       + "SELECT ref AS Ref, CAST(ROUND(COALESCE(SUM(qty), 0), 2) AS DOUBLE) AS Stock_Qty "
         "FROM stock_lines WHERE ref IS NOT NULL GROUP BY ref")
def stock_agg(spark, sf_dir):
    """A2: snapshot SUM(qty) by Ref, rounded to 2 dp."""
    out = R.aggregate_side(T.stock_lines(spark, sf_dir), out="Stock_Qty")
    return out.select("Ref", F.col("Stock_Qty").cast("double").alias("Stock_Qty"))


# --- period filters ---------------------------------------------------------

@query("cutoff_cumulative", S.recon_sql(
    "stock_lines", "mov_cut", mov_cut="SELECT * FROM mov_lines WHERE mov_date < DATE '1998-07-01'"))
def cutoff_cumulative(spark, sf_dir):
    """ledger up to the end of June 1998 (earlier years included)."""
    mov = cumulative_cutoff(T.mov_lines(spark, sf_dir), 1998, 6)
    return R.reconcile(T.stock_lines(spark, sf_dir), mov)


@query("cutoff_exact_month", S.recon_sql(
    "stock_lines", "mov_cut",
    mov_cut="SELECT * FROM mov_lines WHERE mov_date >= DATE '1998-06-01' AND mov_date < DATE '1998-07-01'"))
def cutoff_exact_month(spark, sf_dir):
    """ledger restricted to June 1998 only."""
    mov = exact_month(T.mov_lines(spark, sf_dir), 1998, 6)
    return R.reconcile(T.stock_lines(spark, sf_dir), mov)


@query("cutoff_no_date", S.recon_sql("stock_lines", "mov_lines"))
def cutoff_no_date(spark, sf_dir):
    """a ledger without a date column is not filtered."""
    mov = cumulative_cutoff(T.mov_lines(spark, sf_dir), 1998, 6, has_date=False)
    return R.reconcile(T.stock_lines(spark, sf_dir), mov)


@query("location_empty_list", S.recon_sql("mov_lines", "mov_lines"))
def location_empty_list(spark, sf_dir):
    """an empty location list keeps every snapshot line."""
    return R.reconcile(loc_in(T.mov_lines(spark, sf_dir), [" "]), T.mov_lines(spark, sf_dir))


# --- rounding order and tolerance -------------------------------------------

@query("round_then_sum", cte(value_lines=S.VALUE_LINES)
       + "SELECT ref AS Ref, CAST(ROUND(SUM(ROUND(qty, 2)), 2) AS DOUBLE) AS Value_Rounded, "
         "CAST(ROUND(SUM(qty), 2) AS DOUBLE) AS Value_Raw FROM value_lines GROUP BY ref")
def round_then_sum(spark, sf_dir):
    """Round each line to 2 dp before summing, against sum-then-round."""
    v = T.value_lines(spark, sf_dir)
    return v.where(F.col("ref").isNotNull()).groupBy(F.col("ref").alias("Ref")).agg(
        F.round(F.sum(F.round("qty", 2)), 2).cast("double").alias("Value_Rounded"),
        F.round(F.sum("qty"), 2).cast("double").alias("Value_Raw"))


@query("reconcile_tolerance", S.recon_sql("value_lines", "value_lines", tolerance=0.02,
                                          stock_round=2, value_lines=S.VALUE_LINES))
def reconcile_tolerance(spark, sf_dir):
    """|Difference| <= 0.02 counts as a match (rounded vs raw line values)."""
    v = T.value_lines(spark, sf_dir)
    return R.reconcile(v, v, tolerance=0.02, stock_round=2)


# --- location rules ---------------------------------------------------------

@query("location_in", S.recon_sql(
    "stock_in", "mov_lines", stock_in="SELECT * FROM mov_lines WHERE localisation IN ('A', 'R')"))
def location_in(spark, sf_dir):
    """Snapshot lines of several listed locations summed for one atelier."""
    stock = loc_in(T.mov_lines(spark, sf_dir), ["A", "R "])
    return R.reconcile(stock, T.mov_lines(spark, sf_dir))


@query("location_pair_in", S.recon_sql(
    "stock_in", "mov_lines",
    stock_in="SELECT * FROM mov_lines WHERE (local = 'F' AND localisation = 'A') "
             "OR (local = 'O' AND localisation = 'N')"))
def location_pair_in(spark, sf_dir):
    """snapshot filtered by (LOCAL, LOCALISATION) pairs."""
    stock = pair_in(T.mov_lines(spark, sf_dir), [("F", "A"), ("O", "N")])
    return R.reconcile(stock, T.mov_lines(spark, sf_dir))


@query("location_not_in", S.recon_sql(
    "stock_in", "mov_in", tolerance=0.02,
    stock_in="SELECT * FROM mov_lines WHERE localisation IN ('A', 'R')",
    mov_in="SELECT * FROM mov_lines WHERE mov_date < DATE '1998-07-01' AND localisation IS NOT NULL "
           "AND localisation NOT IN ('N') AND localisation IN ('A', 'R')"))
def location_not_in(spark, sf_dir):
    """F8: configured include list minus exclusions, on both sides."""
    lines = T.mov_lines(spark, sf_dir)
    stock, mov = implicit_selection(lines, cumulative_cutoff(lines, 1998, 6),
                                    include=["A", "N", "R"], exclude=["N"])
    return R.reconcile(stock, mov, tolerance=0.02)


@query("location_implicit", S.recon_sql(
    "stock_in", "mov_in", tolerance=0.02,
    locs="SELECT DISTINCT localisation AS location FROM stock_lines "
         "WHERE localisation IS NOT NULL AND localisation NOT IN ('N')",
    stock_in="SELECT * FROM stock_lines WHERE localisation IN (SELECT location FROM locs)",
    mov_in="SELECT * FROM mov_lines WHERE mov_date < DATE '1998-07-01' AND localisation NOT IN ('N') "
           "AND localisation <> '' AND localisation IN (SELECT location FROM locs)"))
def location_implicit(spark, sf_dir):
    """include = every snapshot location minus exclusions."""
    stock, mov = implicit_selection(T.stock_lines(spark, sf_dir),
                                    cumulative_cutoff(T.mov_lines(spark, sf_dir), 1998, 6),
                                    exclude=["N"])
    return R.reconcile(stock, mov, tolerance=0.02)
