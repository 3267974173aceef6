"""Registered queries: text cleaning, numeric coercion, date parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_dayfirst
from ledgerlens.functions.numbers import coerce_locale_number as locale_fn, coerce_number as number_fn, qty_or_zero
from ledgerlens.functions.text import normalize_label as label_fn, normalize_ref as ref_fn, strip_text
from ledgerlens.operators import dates as D
from ledgerlens.operators import reconcile as R
from ledgerlens.plans.registry import cte, query
from ledgerlens.plans.sql_adapters import SQL_WS, sql_strip
from ledgerlens.sources import tables as T
from ledgerlens.sources.text_adapters import text_dates, text_qty, text_ref

TEXT_REF = ("SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN '  ' || p_brand || ' ' || pr || chr(9) "
            "WHEN 1 THEN chr(160) || pr || ' ' WHEN 2 THEN chr(9) || p_name || ' ' || pr "
            "ELSE pr || chr(160) || chr(160) END AS raw "
            "FROM (SELECT *, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS pr FROM part) x")
TEXT_QTY = ("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN q WHEN 1 THEN ' ' || e || ' ' "
            "WHEN 2 THEN replace(e, '.', ',') "
            "WHEN 3 THEN regexp_replace(e, '^([0-9]+)([0-9]{3})\\.', '\\1' || chr(160) || '\\2,') "
            "ELSE CAST(l_linenumber AS VARCHAR) || 'd' END AS raw "
            "FROM (SELECT *, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS q, "
            "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS e FROM lineitem) x")
TEXT_DATES = ("SELECT 'F' || CAST(l_linenumber AS VARCHAR) AS file_id, l_orderkey AS row_idx, "
              "CASE WHEN l_linenumber <= 2 THEN strftime(CAST(l_shipdate AS DATE), '%-d/%-m/%Y') "
              "WHEN l_linenumber <= 4 THEN strftime(CAST(l_shipdate AS DATE), '%-m/%-d/%Y') "
              "WHEN l_linenumber = 5 THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') "
              "ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS VARCHAR) END AS raw, "
              "CAST(l_shipdate AS DATE) AS ship_date FROM lineitem")

_DOT = "regexp_replace({}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1,\\2', 'g')"


def _sql_norm_ref(x: str) -> str:
    return f"NULLIF({_DOT.format(_DOT.format(sql_strip(x)))}, '')"


def _sql_iso(x):
    return f"CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)"


def _sql_dayfirst(x):
    return f"COALESCE({_sql_iso(x)}, CAST(try_strptime({x}, '%d/%m/%Y') AS DATE))"


def _sql_monthfirst(x):
    return f"COALESCE({_sql_iso(x)}, CAST(try_strptime({x}, '%m/%d/%Y') AS DATE))"


@query("trim_text", cte(t=TEXT_REF) + f"SELECT p_partkey, raw, {sql_strip('raw')} AS trimmed FROM t")
def trim_text(spark, sf_dir):
    """Strip Unicode whitespace (tabs, NBSP) from both ends."""
    t = text_ref(spark, sf_dir)
    return t.select("p_partkey", "raw", strip_text("raw").alias("trimmed"))


@query("normalize_ref", cte(t=TEXT_REF) + f"SELECT p_partkey, {_sql_norm_ref('raw')} AS Ref FROM t")
def normalize_ref(spark, sf_dir):
    """Strip, then digit '.' digit -> digit ',' digit."""
    return text_ref(spark, sf_dir).select("p_partkey", ref_fn("raw").alias("Ref"))


_NUM = f"TRY_CAST({sql_strip('raw')} AS DECIMAL(18,4))"


@query("coerce_number", cte(t=TEXT_QTY) + f"SELECT l_orderkey, l_linenumber, raw, CAST({_NUM} AS DOUBLE) AS qty, "
       f"CAST(COALESCE({_NUM}, 0) AS DOUBLE) AS qty0 FROM t")
def coerce_number(spark, sf_dir):
    """Lenient numeric text -> NULL when bad, and the NULL -> 0 form."""
    t = text_qty(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "raw", number_fn("raw").cast("double").alias("qty"),
                    qty_or_zero("raw").cast("double").alias("qty0"))


_LOC = "replace(replace(replace(raw, chr(160), ''), ' ', ''), ',', '.')"


@query("coerce_locale_number", cte(t=TEXT_QTY) + "SELECT l_orderkey, l_linenumber, "
       f"CAST(COALESCE(TRY_CAST({sql_strip(_LOC)} AS DECIMAL(18,4)), 0) AS DOUBLE) AS qty FROM t")
def coerce_locale_number(spark, sf_dir):
    """P5: drop NBSP / spaces, decimal comma -> dot, bad -> 0."""
    t = text_qty(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", locale_fn("raw").cast("double").alias("qty"))


BLANK_REF = ("SELECT CASE WHEN l_linenumber = 3 THEN chr(160) || '  ' WHEN l_linenumber = 5 THEN '' "
             "ELSE CAST(l_orderkey AS VARCHAR) END AS raw, CAST(l_quantity AS DECIMAL(18,4)) AS qty FROM lineitem")


@query("drop_blank", cte(b=BLANK_REF, n=f"SELECT {_sql_norm_ref('raw')} AS ref, qty FROM b")
       + "SELECT ref AS Ref, CAST(ROUND(COALESCE(SUM(qty), 0), 2) AS DOUBLE) AS Calc_Mov_Qty, "
         "COUNT(*) AS n_lines FROM n WHERE ref IS NOT NULL GROUP BY ref")
def drop_blank(spark, sf_dir):
    """Blank (whitespace-only) refs never form a group."""
    li = T.read_table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    raw = (F.when(n == 3, F.lit("\u00a0  ")).when(n == 5, F.lit(""))
           .otherwise(F.col("l_orderkey").cast("string")))
    lines = li.select(ref_fn(raw).alias("ref"), F.col("l_quantity").cast("decimal(18,4)").alias("qty"))
    return (lines.where(F.col("ref").isNotNull()).groupBy(F.col("ref").alias("Ref"))
            .agg(R.sum_round2(F.col("qty")).cast("double").alias("Calc_Mov_Qty"),
                 F.count(F.lit(1)).alias("n_lines")))


LABEL_RAW = "' ' || replace(upper(p_name), ' ', chr(10) || '  ') || chr(9) || p_brand"


@query("normalize_label", "SELECT p_partkey, lower(" + sql_strip(f"regexp_replace({LABEL_RAW}, '{SQL_WS}+', ' ', 'g')")
       + ") AS label FROM part")
def normalize_label(spark, sf_dir):
    """Collapse whitespace runs (newlines included), trim, lower."""
    p = T.read_table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" "), F.regexp_replace(F.upper("p_name"), " ", "\n  "), F.lit("\t"), F.col("p_brand"))
    return p.select("p_partkey", label_fn(raw).alias("label"))


# --- dates ------------------------------------------------------------------

@query("parse_dates", cte(t=TEXT_DATES) + f"SELECT file_id, row_idx, raw, {_sql_dayfirst('raw')} AS mov_date FROM t")
def parse_dates(spark, sf_dir):
    """Day-first text dates (ISO first), unparsable -> NULL."""
    t = text_dates(spark, sf_dir)
    return t.select("file_id", "row_idx", "raw", parse_dayfirst("raw").alias("mov_date"))


_MD = "^(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})"
_ISO = "^\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}"
_DETECT = cte(
    t=TEXT_DATES,
    s0=f"SELECT file_id, {sql_strip('raw')} AS v FROM t WHERE raw IS NOT NULL",
    s=f"SELECT file_id, v, regexp_matches(v, '{_ISO}') AS iso, regexp_matches(v, '{_MD}') AS md, "
      f"TRY_CAST(regexp_extract(v, '{_MD}', 1) AS INTEGER) AS a, "
      f"TRY_CAST(regexp_extract(v, '{_MD}', 2) AS INTEGER) AS b FROM s0 WHERE v <> ''",
    c="SELECT file_id, CAST(COUNT(*) AS BIGINT) AS n_values, "
      "CAST(SUM(CASE WHEN iso THEN 1 ELSE 0 END) AS BIGINT) AS n_iso, "
      "CAST(SUM(CASE WHEN NOT iso AND md AND a > 12 AND b <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS n_eu, "
      "CAST(SUM(CASE WHEN NOT iso AND md AND b > 12 AND a <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS n_us "
      "FROM s GROUP BY file_id",
    det="SELECT file_id, CASE WHEN n_values = 0 THEN 'unknown' WHEN n_us > n_eu AND n_us > 0 THEN 'us' "
        "WHEN n_eu > n_us AND n_eu > 0 THEN 'eu' WHEN n_iso > 0 AND n_iso >= n_values * 0.5 THEN 'iso' "
        "ELSE 'eu' END AS date_order, n_us, n_eu, n_iso, n_values FROM c")


@query("detect_date_order", _DETECT + "SELECT * FROM det")
def detect_date_order(spark, sf_dir):
    """US / EU / ISO vote over all values of each file."""
    return D.detect_date_order(text_dates(spark, sf_dir), ["file_id"], "raw")


@query("parse_dates_auto", _DETECT + "SELECT t.file_id, t.row_idx, COALESCE(det.date_order, 'unknown') AS date_order, "
       f"CASE WHEN det.date_order IN ('us', 'iso') THEN {_sql_monthfirst('t.raw')} "
       f"ELSE {_sql_dayfirst('t.raw')} END AS mov_date FROM t LEFT JOIN det ON t.file_id = det.file_id")
def parse_dates_auto(spark, sf_dir):
    """P10: parse every file by its detected order."""
    out = D.parse_dates_auto(text_dates(spark, sf_dir), ["file_id"], "raw")
    return out.select("file_id", "row_idx", "date_order", "mov_date")


_NUMV = f"CAST(TRY_CAST(NULLIF({sql_strip('raw')}, '') AS DECIMAL(38,10)) AS DOUBLE)"


@query("excel_serial_dates", cte(
    t=TEXT_DATES,
    g=f"SELECT file_id, COUNT({_NUMV}) = COUNT(*) AND COUNT(*) > 0 AND median({_NUMV}) BETWEEN 20000 AND 60000 "
      f"AS is_serial FROM t WHERE raw IS NOT NULL AND {sql_strip('raw')} <> '' GROUP BY file_id",
    p=f"SELECT t.file_id, t.row_idx, CASE WHEN COALESCE(g.is_serial, false) "
      f"THEN DATE '1899-12-30' + CAST(floor({_NUMV.replace('raw', 't.raw')}) AS INTEGER) "
      f"ELSE {_sql_dayfirst('t.raw')} END AS mov_date FROM t LEFT JOIN g ON t.file_id = g.file_id")
    + "SELECT * FROM p WHERE mov_date IS NOT NULL")
def excel_serial_dates(spark, sf_dir):
    """Serial day numbers where the column's median is a plausible
    serial date, day-first text otherwise; rows without a date are dropped."""
    out = D.coerce_dates(text_dates(spark, sf_dir), ["file_id"], "raw")
    return out.where(F.col("mov_date").isNotNull()).select("file_id", "row_idx", "mov_date")
