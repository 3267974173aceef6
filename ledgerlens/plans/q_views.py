"""Registered queries: list order, sorting, search, sign, formatting, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.text import contains_ci, format_2dp, sign_class as sign_fn, similarity as sim_fn
from ledgerlens.operators import reconcile as R
from ledgerlens.operators.cutoff import cumulative_cutoff
from ledgerlens.operators.jobs import expand_jobs, jobs_frame
from ledgerlens.operators.ordering import discrepancy_order_abs, discrepancy_order_signed, rank_within
from ledgerlens.plans import sql_adapters as S
from ledgerlens.plans.registry import cte, query
from ledgerlens.sources import tables as T

_RECON = cte(mov_lines=S.MOV_LINES, stock_lines=S.STOCK_LINES,
             s=S.side_agg("stock_lines", "Stock_Qty"), m=S.side_agg("mov_lines", "Calc_Mov_Qty"),
             recon=S.recon_select(S.full_join("s", "m")))

# two jobs: job 0 covers location A, job 1 location N; ledger cut at June 1998
TWO_JOBS = [["A"], ["N"]]
_JOBS_SQL = (cte(mov_lines=S.MOV_LINES,
                 jl="SELECT CASE localisation WHEN 'A' THEN 0 ELSE 1 END AS job_idx, * FROM mov_lines "
                    "WHERE localisation IN ('A', 'N')",
                 jm="SELECT * FROM jl WHERE mov_date < DATE '1998-07-01'",
                 s=S.side_agg("jl", "Stock_Qty", keys="job_idx"),
                 m=S.side_agg("jm", "Calc_Mov_Qty", keys="job_idx"),
                 recon=S.recon_select(S.full_join("s", "m", ["job_idx"]), "job_idx")))


def _recon(spark, sf_dir):
    return R.reconcile(T.stock_lines(spark, sf_dir), T.mov_lines(spark, sf_dir))


def _multi_job(spark, sf_dir):
    lines = expand_jobs(T.mov_lines(spark, sf_dir), jobs_frame(spark, TWO_JOBS))
    return R.reconcile(lines, cumulative_cutoff(lines, 1998, 6), keys=["job_idx"])


@query("disc_order_signed", _RECON + "SELECT Ref, Difference, CAST(row_number() OVER "
       "(ORDER BY Difference DESC, Ref) AS INTEGER) AS rank FROM recon WHERE status = 'discrepancy'")
def disc_order_signed(spark, sf_dir):
    """O1: discrepancies numbered by Difference desc (Ref breaks ties)."""
    disc = _recon(spark, sf_dir).where(F.col("status") == R.DISCREPANCY).select("Ref", "Difference")
    return rank_within(disc, [], discrepancy_order_signed())


@query("multi_job", _JOBS_SQL + "SELECT * FROM recon")
def multi_job(spark, sf_dir):
    """Jobs expanded from nested config; results appended by job."""
    return _multi_job(spark, sf_dir)


@query("disc_order_abs", _JOBS_SQL + "SELECT job_idx, Ref, Difference, CAST(row_number() OVER "
       "(ORDER BY abs(Difference) DESC, job_idx, Ref) AS INTEGER) AS rank FROM recon "
       "WHERE status = 'discrepancy'")
def disc_order_abs(spark, sf_dir):
    """O2: appended job results ordered by |Difference| desc."""
    disc = (_multi_job(spark, sf_dir).where(F.col("status") == R.DISCREPANCY)
            .select("job_idx", "Ref", "Difference"))
    return rank_within(disc, [], discrepancy_order_abs(["job_idx"]))


@query("sort_results", _RECON + "SELECT Ref, Stock_Qty, CAST(row_number() OVER (ORDER BY "
       "COALESCE(Stock_Qty, 0), Difference DESC, Ref) AS INTEGER) AS rank FROM recon "
       "WHERE status = 'discrepancy'")
def sort_results(spark, sf_dir):
    """Stable numeric sort of the discrepancy view by Stock_Qty."""
    disc = _recon(spark, sf_dir).where(F.col("status") == R.DISCREPANCY)
    order = [F.coalesce(F.col("Stock_Qty"), F.lit(0.0)).asc(), *discrepancy_order_signed()]
    return rank_within(disc.select("Ref", "Stock_Qty", "Difference"), [], order).drop("Difference")


@query("search_ref", _RECON + "SELECT * FROM recon WHERE contains(lower(Ref), '77')")
def search_ref(spark, sf_dir):
    """case-insensitive substring search on Ref."""
    return _recon(spark, sf_dir).where(contains_ci("Ref", "77"))


@query("sign_class", cte(part_diff=S.PART_DIFF) + "SELECT Ref, CAST(Difference AS DOUBLE) AS Difference, "
       "CASE WHEN Difference > 0 THEN 'positive' WHEN Difference < 0 THEN 'negative' ELSE '' END "
       "AS sign_class FROM part_diff")
def sign_class(spark, sf_dir):
    """P20: positive / negative / none row class."""
    d = T.part_diff(spark, sf_dir)
    return d.select("Ref", F.col("Difference").cast("double").alias("Difference"),
                    sign_fn("Difference").alias("sign_class"))


@query("format_report", _RECON + "SELECT Ref, COALESCE(printf('%.2f', Stock_Qty), '0') AS stock_txt, "
       "COALESCE(printf('%.2f', Calc_Mov_Qty), '0') AS mov_txt, COALESCE(printf('%.2f', Difference), '0') "
       "AS diff_txt FROM recon WHERE status = 'discrepancy'")
def format_report(spark, sf_dir):
    """Fixed two-decimal text for the report columns."""
    disc = _recon(spark, sf_dir).where(F.col("status") == R.DISCREPANCY)
    return disc.select("Ref", format_2dp("Stock_Qty").alias("stock_txt"),
                       format_2dp("Calc_Mov_Qty").alias("mov_txt"),
                       format_2dp("Difference").alias("diff_txt"))


@query("similarity", cte(p="SELECT p_partkey, p_name || ' ' || p_brand AS t FROM part")
       + "SELECT a.p_partkey, a.t AS text1, b.t AS text2, " + S.sql_sim("a.t", "b.t")
       + " AS similarity FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1")
def similarity(spark, sf_dir):
    """Edit-distance similarity of neighbouring part labels."""
    part = T.read_table(spark, sf_dir, "part")
    p = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("t"))
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return j.select(F.col("a.p_partkey").alias("p_partkey"), F.col("a.t").alias("text1"),
                    F.col("b.t").alias("text2"), sim_fn("a.t", "b.t").alias("similarity"))
