"""Registered queries: the all-units end-to-end run over sheet grids."""

from __future__ import annotations

from ledgerlens.plans.pipeline import demo_inputs, run_units
from ledgerlens.plans.registry import cte, query
from ledgerlens.plans.sql_grid import DIAGNOSTICS_UNITS

_SQL = (cte(
    st="SELECT l_returnflag AS atelier, CAST(l_orderkey AS VARCHAR) AS ref, CAST(l_quantity AS DECIMAL(18,4)) AS qty "
       "FROM lineitem WHERE l_shipdate < DATE '1998-07-01'",
    jobs="SELECT * FROM (VALUES ('Fath1', 'A'), ('Fath1', 'N'), ('Mdoukal', 'A'), ('Mdoukal', 'N'), "
         "('Mdoukal', 'R')) v(unit, atelier)",
    mv="SELECT CASE l_linestatus WHEN 'F' THEN 'Fath1' ELSE 'Mdoukal' END AS unit, l_returnflag AS atelier, "
       "CAST(l_orderkey AS VARCHAR) AS ref, CAST(l_quantity AS DECIMAL(18,4)) AS qty FROM lineitem "
       "WHERE (l_linestatus = 'F' AND l_returnflag IN ('A', 'N')) "
       "OR (l_linestatus = 'O' AND (l_returnflag = 'N' OR l_shipdate < DATE '1998-07-01'))",
    s="SELECT j.unit, st.atelier, st.ref AS Ref, ROUND(COALESCE(SUM(CASE WHEN j.unit = 'Mdoukal' "
      "THEN ROUND(st.qty, 2) ELSE st.qty END), 0), 2) AS Stock_Qty FROM st JOIN jobs j ON st.atelier = j.atelier "
      "GROUP BY j.unit, st.atelier, st.ref",
    m="SELECT unit, atelier, ref AS Ref, ROUND(COALESCE(SUM(CASE WHEN unit = 'Mdoukal' THEN ROUND(qty, 2) "
      "ELSE qty END), 0), 2) AS Calc_Mov_Qty FROM mv GROUP BY unit, atelier, ref",
    j="SELECT COALESCE(s.unit, m.unit) AS unit, COALESCE(s.atelier, m.atelier) AS atelier, "
      "COALESCE(s.Ref, m.Ref) AS Ref, COALESCE(Stock_Qty, 0) AS sq, COALESCE(Calc_Mov_Qty, 0) AS mq "
      "FROM s FULL OUTER JOIN m ON s.unit = m.unit AND s.atelier = m.atelier AND s.Ref = m.Ref")
    + "SELECT unit, atelier, 0 AS job_idx, Ref, CAST(sq AS DOUBLE) AS Stock_Qty, CAST(mq AS DOUBLE) AS Calc_Mov_Qty, "
      "CAST(sq - mq AS DOUBLE) AS Difference, CASE WHEN (unit = 'Fath1' AND sq - mq = 0) "
      "OR (unit = 'Mdoukal' AND ABS(sq - mq) <= 0.02) THEN 'match' ELSE 'discrepancy' END AS status FROM j")


@query("reconcile_units", _SQL)
def reconcile_units(spark, sf_dir):
    """S12/H1/H9/F1/F3/F6/A1/A2/A5/J1/F13/F14/D1 end to end: one snapshot
    workbook and six ledger workbooks, two units with different profiles
    (no period + exact match; cumulative cutoff + per-line rounding +
    tolerance), every atelier in one plan.  The 'F' ledger of location R has
    no column the first profile knows and yields a diagnostic instead."""
    sgrid, mgrid, jobs, rules = demo_inputs(spark, sf_dir)
    recon, _diag = run_units(sgrid, mgrid, jobs, rules, 1998, 6)
    return recon


@query("diagnostics_units", DIAGNOSTICS_UNITS)
def diagnostics_units(spark, sf_dir):
    """The diagnostics side of the all-units run (unreadable ledgers)."""
    sgrid, mgrid, jobs, rules = demo_inputs(spark, sf_dir)
    _recon, diag = run_units(sgrid, mgrid, jobs, rules, 1998, 6)
    return diag
