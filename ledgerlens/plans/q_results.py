"""Registered queries: roll-forward, edits, summary, report, config lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.numbers import QTY
from ledgerlens.operators import reconcile as R
from ledgerlens.operators.cutoff import cumulative_cutoff, exact_month
from ledgerlens.operators.edits import apply_deletes as deletes_op, apply_log, apply_renames
from ledgerlens.operators.ordering import discrepancy_order_abs
from ledgerlens.operators.report import report_lines as lines_op, report_select as select_op, summary as summary_op
from ledgerlens.operators.rollforward import rollforward as rollforward_op
from ledgerlens.plans import sql_adapters as S
from ledgerlens.plans.registry import cte, query
from ledgerlens.sources import tables as T

# --- roll-forward -----------------------------------------------------------

PART_LINES = ("SELECT CAST(l_partkey AS VARCHAR) AS ref, CAST(l_quantity AS DECIMAL(18,4)) AS qty, "
              "CAST(l_shipdate AS DATE) AS mov_date, l_returnflag AS localisation FROM lineitem")


def _part_lines(spark, sf_dir):
    li = T.read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").cast("string").alias("ref"), F.col("l_quantity").cast(QTY).alias("qty"),
                     F.col("l_shipdate").cast("date").alias("mov_date"),
                     F.col("l_returnflag").alias("localisation"))


def _rollforward_sql(with_opening: bool) -> str:
    opening = ("SELECT ref, ROUND(COALESCE(SUM(qty), 0), 2) AS o FROM pl WHERE mov_date < DATE '1998-06-01' "
               "AND ref IS NOT NULL GROUP BY ref") if with_opening else \
              "SELECT ref, CAST(NULL AS DECIMAL(18,2)) AS o FROM pl WHERE false"
    return (cte(pl=PART_LINES, op=opening,
                mv="SELECT ref, ROUND(COALESCE(SUM(ROUND(COALESCE(qty, 0), 2)), 0), 2) AS m FROM pl "
                   "WHERE mov_date >= DATE '1998-06-01' AND mov_date < DATE '1998-07-01' "
                   "AND localisation <> 'R' AND ref IS NOT NULL GROUP BY ref",
                cl="SELECT ref, ROUND(COALESCE(SUM(qty), 0), 2) AS c FROM pl WHERE mov_date < DATE '1998-07-01' "
                   "AND ref IS NOT NULL GROUP BY ref",
                ex="SELECT COALESCE(op.ref, mv.ref) AS ref, ROUND(COALESCE(o, 0) + COALESCE(m, 0), 2) AS e "
                   "FROM op FULL OUTER JOIN mv ON op.ref = mv.ref",
                j="SELECT COALESCE(cl.ref, ex.ref) AS Ref, COALESCE(c, 0) AS sq, COALESCE(e, 0) AS mq, "
                  "ROUND(COALESCE(c, 0) - COALESCE(e, 0), 2) AS d FROM cl FULL OUTER JOIN ex ON cl.ref = ex.ref")
            + "SELECT Ref, CAST(sq AS DOUBLE) AS Stock_Qty, CAST(mq AS DOUBLE) AS Calc_Mov_Qty, "
              "CAST(d AS DOUBLE) AS Difference, CASE WHEN ABS(d) <= 0.02 THEN 'match' ELSE 'discrepancy' END "
              "AS status FROM j")


def _rollforward(spark, sf_dir, with_opening):
    pl = _part_lines(spark, sf_dir)
    opening = pl.where(F.col("mov_date") < F.lit("1998-06-01").cast("date")) if with_opening else None
    period = exact_month(pl, 1998, 6).where(F.col("localisation") != "R")
    closing = cumulative_cutoff(pl, 1998, 6)
    return rollforward_op(closing, period, opening)


@query("rollforward", _rollforward_sql(True))
def rollforward(spark, sf_dir):
    """Closing vs opening + June 1998 movement (by part)."""
    return _rollforward(spark, sf_dir, True)


@query("rollforward_no_opening", _rollforward_sql(False))
def rollforward_no_opening(spark, sf_dir):
    """No opening snapshot for the period: expected = movement only."""
    return _rollforward(spark, sf_dir, False)


# --- unit / atelier results ---------------------------------------------------

_UNIT_RECON = cte(mov_lines=S.MOV_LINES, ul=S.UNIT_LINES,
                  um="SELECT * FROM ul WHERE mov_date < DATE '1998-07-01'",
                  s=S.side_agg("ul", "Stock_Qty", keys="unit, atelier"),
                  m=S.side_agg("um", "Calc_Mov_Qty", keys="unit, atelier"),
                  recon=S.recon_select(S.full_join("s", "m", ["unit", "atelier"]), "unit, atelier"))


def unit_recon(spark, sf_dir):
    """Per (unit, atelier): snapshot = all lines, ledger = lines to June 1998."""
    ul = T.unit_lines(spark, sf_dir)
    return R.reconcile(ul, cumulative_cutoff(ul, 1998, 6), keys=["unit", "atelier"])


@query("summary", _UNIT_RECON + "SELECT unit, atelier, "
       "CAST(SUM(CASE WHEN status = 'match' THEN 1 ELSE 0 END) AS BIGINT) AS n_matches, "
       "CAST(SUM(CASE WHEN status = 'discrepancy' THEN 1 ELSE 0 END) AS BIGINT) AS n_discrepancies "
       "FROM recon GROUP BY ROLLUP (unit, atelier)")
def summary(spark, sf_dir):
    """Counts per atelier with unit and grand totals."""
    return summary_op(unit_recon(spark, sf_dir))


# selection of ateliers for the report (user input, a small table)
REPORT_SELECTION = [("F", "A"), ("O", "N")]
_SEL_SQL = "SELECT * FROM (VALUES ('F', 'A'), ('O', 'N')) v(unit, atelier)"


@query("report_select",
       cte(mov_lines=S.MOV_LINES, ul=S.UNIT_LINES,
           um="SELECT * FROM ul WHERE mov_date < DATE '1998-07-01'",
           s=S.side_agg("ul", "Stock_Qty", keys="unit, atelier"),
           m=S.side_agg("um", "Calc_Mov_Qty", keys="unit, atelier"),
           recon=S.recon_select(S.full_join("s", "m", ["unit", "atelier"]), "unit, atelier"),
           sel=_SEL_SQL)
       + "SELECT r.* FROM recon r SEMI JOIN sel ON r.unit = sel.unit AND r.atelier = sel.atelier "
         "WHERE status = 'discrepancy'")
def report_select(spark, sf_dir):
    """Discrepancies of the ateliers chosen for the report."""
    sel = spark.createDataFrame(REPORT_SELECTION, "unit string, atelier string")
    return select_op(unit_recon(spark, sf_dir), sel)


_FMT = "printf('%.2f', COALESCE({}, 0))"


@query("report_lines", cte(mov_lines=S.MOV_LINES, ul=S.UNIT_LINES,
                           um="SELECT * FROM ul WHERE mov_date < DATE '1998-07-01'",
                           s=S.side_agg("ul", "Stock_Qty", keys="unit, atelier"),
                           m=S.side_agg("um", "Calc_Mov_Qty", keys="unit, atelier"),
                           recon=S.recon_select(S.full_join("s", "m", ["unit", "atelier"]), "unit, atelier"),
                           sel=_SEL_SQL,
                           d="SELECT r.* FROM recon r SEMI JOIN sel ON r.unit = sel.unit AND r.atelier = sel.atelier "
                             "WHERE status = 'discrepancy'",
                           n="SELECT unit, atelier, COUNT(*) AS n FROM d GROUP BY unit, atelier")
       + "SELECT unit, atelier, CAST(row_number() OVER (PARTITION BY unit, atelier ORDER BY Difference DESC, Ref) "
         "+ 2 AS INTEGER) AS line_no, '| ' || Ref || ' | ' || " + _FMT.format("Stock_Qty") + " || ' | ' || "
       + _FMT.format("Calc_Mov_Qty") + " || ' | ' || " + _FMT.format("Difference") + " || ' |' AS line FROM d "
         "UNION ALL SELECT unit, atelier, 0, '## ' || atelier FROM n "
         "UNION ALL SELECT unit, atelier, 1, '| REFERENCE | ETAT STOCKS | FICHIER DE MOV | ECARTS |' FROM n "
         "UNION ALL SELECT unit, atelier, 2, '|-----------|-------------|----------------|--------|' FROM n "
         "UNION ALL SELECT unit, atelier, CAST(n + 3 AS INTEGER), '---' FROM n")
def report_lines(spark, sf_dir):
    """E5/K4: Markdown lines of the report tables, numbered per atelier."""
    sel = spark.createDataFrame(REPORT_SELECTION, "unit string, atelier string")
    return lines_op(select_op(unit_recon(spark, sf_dir), sel))


SKIP = [("F", "R")]


@query("skip_ateliers", _UNIT_RECON + "SELECT * FROM recon WHERE NOT (unit = 'F' AND atelier = 'R')")
def skip_ateliers(spark, sf_dir):
    """F16: ateliers the user skipped are left out of the run."""
    skip = spark.createDataFrame(SKIP, "unit string, atelier string")
    ul = T.unit_lines(spark, sf_dir).join(F.broadcast(skip), ["unit", "atelier"], "left_anti")
    return R.reconcile(ul, cumulative_cutoff(ul, 1998, 6), keys=["unit", "atelier"])


KNOWN_ATELIERS = [("F", "A"), ("F", "N"), ("F", "R"), ("O", "N")]


@query("unknown_ateliers", cte(mov_lines=S.MOV_LINES, ul=S.UNIT_LINES,
                               known="SELECT * FROM (VALUES ('F', 'A'), ('F', 'N'), ('F', 'R'), ('O', 'N')) "
                                     "v(unit, atelier)")
       + "SELECT DISTINCT ul.unit, ul.atelier, 'error' AS severity, 'UNKNOWN_ATELIER' AS code, "
         "'Unknown atelier: ' || ul.atelier AS message FROM ul ANTI JOIN known "
         "ON ul.unit = known.unit AND ul.atelier = known.atelier")
def unknown_ateliers(spark, sf_dir):
    """Requested ateliers without a configuration row -> diagnostics."""
    from ledgerlens.operators.verify import unknown_ateliers as unknown_op
    known = spark.createDataFrame(KNOWN_ATELIERS, "unit string, atelier string")
    requested = T.unit_lines(spark, sf_dir).select("unit", "atelier").distinct()
    return unknown_op(requested, known)


# --- manual edits -------------------------------------------------------------

_RECON = cte(mov_lines=S.MOV_LINES, stock_lines=S.STOCK_LINES,
             s=S.side_agg("stock_lines", "Stock_Qty"), m=S.side_agg("mov_lines", "Calc_Mov_Qty"),
             recon=S.recon_select(S.full_join("s", "m")),
             dels="SELECT CAST(o_orderkey AS VARCHAR) AS ref FROM orders WHERE o_orderpriority = '1-URGENT'")


@query("apply_deletes", _RECON + "SELECT * FROM recon WHERE status = 'discrepancy' "
       "AND Ref NOT IN (SELECT ref FROM dels)")
def apply_deletes(spark, sf_dir):
    """Delete listed refs from the discrepancy view (urgent orders)."""
    recon = R.reconcile(T.stock_lines(spark, sf_dir), T.mov_lines(spark, sf_dir))
    disc = recon.where(F.col("status") == R.DISCREPANCY)
    orders = T.read_table(spark, sf_dir, "orders")
    dels = orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").cast("string").alias("ref"))
    return deletes_op(disc, dels)


@query("edit_first_ref", cte(mov_lines=S.MOV_LINES,
                             jl="SELECT CASE localisation WHEN 'A' THEN 0 ELSE 1 END AS job_idx, * FROM mov_lines "
                                "WHERE localisation IN ('A', 'N')",
                             jm="SELECT * FROM jl WHERE mov_date < DATE '1998-07-01'",
                             s=S.side_agg("jl", "Stock_Qty", keys="job_idx"),
                             m=S.side_agg("jm", "Calc_Mov_Qty", keys="job_idx"),
                             recon=S.recon_select(S.full_join("s", "m", ["job_idx"]), "job_idx"),
                             d="SELECT job_idx, Ref, Difference, row_number() OVER (PARTITION BY Ref "
                               "ORDER BY abs(Difference) DESC, job_idx, Ref) AS rn FROM recon "
                               "WHERE status = 'discrepancy'",
                             ren="SELECT CAST(o_orderkey AS VARCHAR) AS old_ref, "
                                 "CAST(o_orderkey AS VARCHAR) || '-H' AS new_ref FROM orders "
                                 "WHERE o_orderpriority = '2-HIGH'")
       + "SELECT d.job_idx, COALESCE(CASE WHEN rn = 1 THEN ren.new_ref END, d.Ref) AS Ref, d.Difference, "
         "(rn = 1 AND ren.new_ref IS NOT NULL) AS edited FROM d LEFT JOIN ren ON d.Ref = ren.old_ref")
def edit_first_ref(spark, sf_dir):
    """Rename the first row (display order) of each listed ref."""
    from ledgerlens.plans.q_views import _multi_job
    disc = (_multi_job(spark, sf_dir).where(F.col("status") == R.DISCREPANCY)
            .select("job_idx", "Ref", "Difference"))
    orders = T.read_table(spark, sf_dir, "orders")
    ren = orders.where(F.col("o_orderpriority") == "2-HIGH").select(
        F.col("o_orderkey").cast("string").alias("old_ref"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("-H")).alias("new_ref"))
    return apply_renames(disc, ren, discrepancy_order_abs(["job_idx"]))


# The log of the query: edits of orders in blocks of eight, so that the oracle
# knows without looking for them which refs can meet.
_LOG_SQL = """o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderkey AS VARCHAR) AS ref, o_orderpriority AS p,
    (o_orderkey % 3) * 1000000000000 + CAST(o_orderkey AS BIGINT) * 10 AS seq FROM orders),
log AS (SELECT seq, 'delete' AS action, ref, '' AS new_ref, k // 8 AS g FROM o WHERE p = '1-URGENT'
  UNION ALL SELECT seq, 'rename', ref, CAST(k + 1 AS VARCHAR), k // 8 FROM o WHERE p = '2-HIGH' AND k % 8 < 7
  UNION ALL SELECT seq + 1, 'rename', CAST(k + 1 AS VARCHAR), ref || '-H', k // 8 FROM o WHERE p = '2-HIGH' AND k % 8 < 7
  UNION ALL SELECT seq, 'rename', ref, ' ' || ref || '-M ', k // 8 FROM o WHERE p = '3-MEDIUM'
  UNION ALL SELECT seq + 1, 'rename', ref, ref || '-N', k // 8 FROM o WHERE p = '3-MEDIUM'
  UNION ALL SELECT seq + 2, 'rename', ref || '-M', ref, k // 8 FROM o WHERE p = '3-MEDIUM'
  UNION ALL SELECT seq + 3, 'rename', ref, '  ', k // 8 FROM o WHERE p = '3-MEDIUM'
  UNION ALL SELECT seq, 'rename', ref, CAST(k - 1 AS VARCHAR), k // 8 FROM o WHERE p = '4-NOT SPECIFIED' AND k % 8 > 0)"""

_EDIT_LOG = cte(mov_lines=S.MOV_LINES,
                jl="SELECT CASE localisation WHEN 'A' THEN 0 ELSE 1 END AS job_idx, * FROM mov_lines WHERE localisation IN ('A', 'N')",
                jm="SELECT * FROM jl WHERE mov_date < DATE '1998-07-01'", s=S.side_agg("jl", "Stock_Qty", keys="job_idx"),
                m=S.side_agg("jm", "Calc_Mov_Qty", keys="job_idx"), recon=S.recon_select(S.full_join("s", "m", ["job_idx"]), "job_idx"))


@query("edit_log", _EDIT_LOG.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _LOG_SQL + """,
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS n FROM log),
v AS (SELECT job_idx, Ref, Difference, CAST(Ref AS BIGINT) // 8 AS g,
        row_number() OVER (ORDER BY abs(Difference) DESC, job_idx, Ref) AS place FROM recon WHERE status = 'discrepancy'),
st AS (SELECT 0 AS n, job_idx, Difference, g, place, Ref, false AS edited FROM v
  UNION ALL SELECT n, job_idx, Difference, g, place, CASE WHEN hit THEN trim(new_ref) ELSE Ref END, edited OR hit FROM (
    SELECT e.n, st.job_idx, st.Difference, st.g, st.place, st.Ref, st.edited, e.action, e.ref AS old_ref, e.new_ref,
           e.action = 'rename' AND trim(e.new_ref) <> '' AND st.Ref = e.ref
             AND st.place = min(CASE WHEN st.Ref = e.ref THEN st.place END) OVER (PARTITION BY st.g) AS hit
    FROM st JOIN e ON e.g = st.g AND e.n = st.n + 1) x WHERE NOT (action = 'delete' AND Ref = old_ref)),
z AS (SELECT g, max(n) AS n FROM e GROUP BY g)
SELECT st.job_idx, st.Ref, st.Difference, st.edited FROM st LEFT JOIN z USING (g) WHERE st.n = coalesce(z.n, 0)
""")
def edit_log(spark, sf_dir):
    """Deletes and renames one after the other over the discrepancies
    of two jobs: second edits of a ref, chains, refs that come back."""
    from ledgerlens.plans.q_views import _multi_job
    disc = (_multi_job(spark, sf_dir).where(F.col("status") == R.DISCREPANCY)
            .select("job_idx", "Ref", "Difference"))
    o = T.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderpriority").alias("p"))
    name = lambda d=0: (F.col("k") + d).cast("string")
    add = lambda text: F.concat(name(), F.lit(text))
    high, medium = (F.col("p") == "2-HIGH") & (F.col("k") % 8 < 7), F.col("p") == "3-MEDIUM"
    seq = (F.col("k") % 3) * 1000000000000 + F.col("k") * 10
    steps = [(F.col("p") == "1-URGENT", 0, "delete", name(), F.lit("")), (high, 0, "rename", name(), name(1)), (high, 1, "rename", name(1), add("-H")),
             (medium, 0, "rename", name(), F.concat(F.lit(" "), name(), F.lit("-M "))), (medium, 1, "rename", name(), add("-N")),
             (medium, 2, "rename", add("-M"), name()), (medium, 3, "rename", name(), F.lit("  ")),
             ((F.col("p") == "4-NOT SPECIFIED") & (F.col("k") % 8 > 0), 0, "rename", name(), name(-1))]
    made = F.array_compact(F.array(*[F.when(when, F.struct((seq + i).alias("seq"), F.lit(action).alias("action"), old.alias("ref"), new.alias("new_ref")))
                                     for when, i, action, old, new in steps]))
    log = o.select(F.explode(made).alias("e")).select("e.*")
    return apply_log(disc, log, discrepancy_order_abs(["job_idx"]))[0]


@query("result_order", _UNIT_RECON + "SELECT unit, atelier, status, Ref, Difference, row_number() OVER (PARTITION BY unit, atelier, status "
       "ORDER BY CASE WHEN status = 'match' THEN 0 WHEN unit = 'O' THEN abs(Difference) ELSE Difference END DESC, Ref) AS position FROM recon")
def result_order(spark, sf_dir):
    """O1/O2/O3: the lists of a unit ordered by signed and of one ordered by
    absolute difference, positions of all in one range sort."""
    from ledgerlens.operators.ordering import positioned
    return positioned(unit_recon(spark, sf_dir).select("unit", "atelier", "status", "Ref", "Difference"), {"F": "signed", "O": "abs"})


_VERSIONS_SQL = cte(
    pl=PART_LINES, p="SELECT * FROM (VALUES ('1998-04', DATE '1998-04-01'), ('1998-05', DATE '1998-05-01'), ('1998-06', DATE '1998-06-01')) v(period, d)",
    op="SELECT period, ref, ROUND(SUM(qty), 2) AS o FROM pl JOIN p ON mov_date < d WHERE ref IS NOT NULL GROUP BY ALL",
    mv="SELECT period, ref, ROUND(COALESCE(SUM(ROUND(COALESCE(qty, 0), 2)), 0), 2) AS m FROM pl JOIN p ON mov_date >= d "
       "AND mov_date < d + INTERVAL 1 MONTH WHERE localisation <> 'R' AND ref IS NOT NULL GROUP BY ALL",
    cl="SELECT period, ref, ROUND(SUM(qty), 2) AS c FROM pl JOIN p ON mov_date < d + INTERVAL 1 MONTH WHERE ref IS NOT NULL GROUP BY ALL",
    u="SELECT period, ref, o, NULL AS m, NULL AS c FROM op UNION ALL SELECT period, ref, NULL, m, NULL FROM mv UNION ALL SELECT period, ref, NULL, NULL, c FROM cl",
    j="SELECT period, ref AS Ref, COALESCE(SUM(c), 0) AS sq, ROUND(COALESCE(SUM(o), 0) + COALESCE(SUM(m), 0), 2) AS mq FROM u GROUP BY ALL",
) + ("SELECT period, Ref, CAST(sq AS DOUBLE) AS Stock_Qty, CAST(mq AS DOUBLE) AS Calc_Mov_Qty, CAST(ROUND(sq - mq, 2) AS DOUBLE) AS Difference, "
     "CASE WHEN ABS(ROUND(sq - mq, 2)) <= 0.02 THEN 'match' ELSE 'discrepancy' END AS status FROM j")


@query("rollforward_versions", _VERSIONS_SQL)
def rollforward_versions(spark, sf_dir):
    """Three months rolled forward in a chain, every closing
    stored and read as the next opening; the closing of May is stored twice,
    first without location R, and the later version counts."""
    from ledgerlens.operators.sinks import fresh_output
    from ledgerlens.sources import versions as V
    pl, path = _part_lines(spark, sf_dir), fresh_output(spark, "closings")
    months = (4, 5, 6)
    for m, lines in [(3, pl), (4, pl), (5, pl.where("localisation <> 'R'")), (5, pl), (6, pl)]:
        closing = cumulative_cutoff(lines, 1998, m).where("ref is not null").groupBy("ref").agg(F.sum("qty").alias("qty"))
        V.append(closing.select(F.lit("P").alias("unit"), F.lit(V.period(1998, m)).alias("period"), "ref", "qty"), path)
    of = F.col("period").isin([V.period(1998, m) for m in months])
    ledger = pl.where(F.col("localisation") != "R").withColumn("period", F.date_format("mov_date", V.PERIOD)).where(of)
    return rollforward_op(V.as_of(spark, path).where(of), ledger, V.openings(spark, path).where(of), keys=("period",))
