"""Registered queries: file names, snapshot periods, roles and matching.

File listings are derived from the tables: one snapshot file per month with
orders, one ledger file per (part type, brand), atelier keywords from part
types and nation names.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import matching as M
from ledgerlens.plans.registry import cte, query
from ledgerlens.session import cut_lineage
from ledgerlens.sources import files as FL
from ledgerlens.sources.tables import read_table

MONTHS_SQL = ("SELECT DISTINCT CAST(month(o_orderdate) AS INTEGER) AS m, CAST(year(o_orderdate) AS INTEGER) AS y "
              "FROM orders")
NAMES_SQL = ("SELECT 'STOCK ' || CAST(m AS VARCHAR) || '-' || CAST(y AS VARCHAR) || '.xlsx' AS file_name FROM months "
             "UNION ALL SELECT 'stock_' || lpad(CAST(m AS VARCHAR), 2, '0') || '_' || CAST(y AS VARCHAR) || '.xls' "
             "FROM months UNION ALL SELECT 'Stock ' || lpad(CAST(m AS VARCHAR), 2, '0') || ' ' || CAST(y AS VARCHAR) "
             "|| ' (1).xlsx' FROM months UNION ALL SELECT 'MOV stock bloc ' || CAST(y AS VARCHAR) || '.xlsx' "
             "FROM months")
_PERIOD_RE = "(?i)stock\\s*(\\d{1,2})\\s*[-_\\s]\\s*(\\d{4})"


def _months(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    # written: filters on names made of the months would move in front of the
    # distinct otherwise, and be computed for every order
    return cut_lineage(o.select(F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y")).distinct(), "months")


def _names(spark, sf_dir):
    mo = _months(spark, sf_dir)
    m, y = F.col("m").cast("string"), F.col("y").cast("string")
    mm = F.lpad(m, 2, "0")
    return mo.select(F.explode(F.array(
        F.concat(F.lit("STOCK "), m, F.lit("-"), y, F.lit(".xlsx")),
        F.concat(F.lit("stock_"), mm, F.lit("_"), y, F.lit(".xls")),
        F.concat(F.lit("Stock "), mm, F.lit(" "), y, F.lit(" (1).xlsx")),
        F.concat(F.lit("MOV stock bloc "), y, F.lit(".xlsx")))).alias("file_name"))


_PERIOD_SQL = (f"CASE WHEN regexp_extract(file_name, '{_PERIOD_RE}', 1) <> '' AND "
               f"TRY_CAST(regexp_extract(file_name, '{_PERIOD_RE}', 1) AS INTEGER) BETWEEN 1 AND 12 "
               f"THEN lpad(CAST(TRY_CAST(regexp_extract(file_name, '{_PERIOD_RE}', 1) AS INTEGER) AS VARCHAR), 2, '0') "
               f"END")
_YEAR_SQL = (f"CASE WHEN ({_PERIOD_SQL}) IS NOT NULL THEN "
             f"TRY_CAST(regexp_extract(file_name, '{_PERIOD_RE}', 2) AS INTEGER) END")


@query("filename_period", cte(months=MONTHS_SQL, names=NAMES_SQL)
       + f"SELECT file_name, {_PERIOD_SQL} AS month, {_YEAR_SQL} AS year FROM names")
def filename_period(spark, sf_dir):
    """Month / year parsed from snapshot file names (NULL when absent)."""
    n = _names(spark, sf_dir)
    p = FL.stock_period(F.col("file_name"))
    return n.select("file_name", p["month"].alias("month"), p["year"].alias("year"))


@query("opening_lookup", cte(months=MONTHS_SQL,
                             snaps="SELECT 'STOCK ' || CAST(m AS VARCHAR) || '-' || CAST(y AS VARCHAR) || '.xlsx' "
                                   "AS file_name, make_date(y, m, 1) AS period FROM months")
       + "SELECT c.file_name, c.period, p.file_name AS prev_file FROM snaps c LEFT JOIN snaps p "
         "ON p.period = c.period - INTERVAL 1 MONTH")
def opening_lookup(spark, sf_dir):
    """Each monthly snapshot paired with the previous month's file."""
    mo = _months(spark, sf_dir)
    snaps = mo.select(F.concat(F.lit("STOCK "), F.col("m").cast("string"), F.lit("-"), F.col("y").cast("string"),
                               F.lit(".xlsx")).alias("file_name"))
    return FL.previous_snapshot(FL.with_period(snaps))


_LISTING_SQL = cte(
    months=MONTHS_SQL, names=NAMES_SQL,
    raw="SELECT '/in/' || file_name AS path FROM names UNION ALL SELECT '/in/' || file_name FROM names "
        "UNION ALL SELECT DISTINCT '/in/MOV ' || p_type || ' ' || p_brand || '.xlsx' FROM part "
        "UNION ALL SELECT '/in/notes ' || n_name || '.txt' FROM nation",
    f="SELECT DISTINCT path, regexp_extract(path, '([^/\\\\]*)$', 1) AS file_name FROM raw")


def _listing(spark, sf_dir):
    names = _names(spark, sf_dir).select(F.concat(F.lit("/in/"), "file_name").alias("path"))
    part = read_table(spark, sf_dir, "part")
    nation = read_table(spark, sf_dir, "nation")
    movs = part.select(F.concat(F.lit("/in/MOV "), "p_type", F.lit(" "), "p_brand", F.lit(".xlsx")).alias("path")).distinct()
    notes = nation.select(F.concat(F.lit("/in/notes "), "n_name", F.lit(".txt")).alias("path"))
    return names.unionByName(names).unionByName(movs).unionByName(notes)


@query("classify_files", _LISTING_SQL + "SELECT path, file_name, lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1)) "
       "AS ext, CASE WHEN contains(lower(file_name), 'stock') AND NOT contains(lower(file_name), 'mov') "
       "THEN 'stock' ELSE 'movement' END AS kind FROM f "
       "WHERE lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1)) IN ('xlsx', 'xls', 'csv')")
def classify_files(spark, sf_dir):
    """Keep spreadsheet / CSV inputs once; stock vs movement."""
    return FL.classify_files(_listing(spark, sf_dir))


# --- matching files to ateliers ----------------------------------------------

# One unit per block of parts, so units grow with the table; a unit's files are
# named after its parts, its ateliers after the words of their names and types,
# so most files suit several ateliers and most ateliers several files.
UNIT_PARTS = 100
_MATCH_SQL = cte(
    p="SELECT 'U' || CAST(p_partkey // 100 AS VARCHAR) AS unit, p_name, p_type, p_brand FROM part",
    names_="SELECT DISTINCT unit, 'MOV ' || p_name || ' ' || p_type || ' ' || p_brand || '.xlsx' AS file_name FROM p",
    files="SELECT unit, file_name, unit || '/' || file_name AS path, "
          "row_number() OVER (PARTITION BY unit ORDER BY md5(file_name), file_name) AS file_pos FROM names_",
    kw="SELECT DISTINCT unit, unnest(string_split(p_name, ' ') || [lower(p_type), lower(p_type) || ' ' || string_split(p_name, ' ')[1]]) AS atelier FROM p",
    ateliers="SELECT unit, atelier, row_number() OVER (PARTITION BY unit ORDER BY atelier) AS atelier_pos FROM kw")


def _greedy_sql(words: bool) -> str:
    """The greedy choice step by step: by atelier (words) or by file."""
    fits = "contains(lower(f.file_name), a.atelier)"
    if words:
        fits = f"({fits} OR list_bool_and(list_transform(string_split(a.atelier, ' '), lambda w: contains(lower(f.file_name), w))))"
    step, take, by = ("atelier_pos", "path", "file_pos") if words else ("file_pos", "atelier", "atelier_pos")
    other = "atelier" if words else "path"
    steps = "ateliers" if words else "files"
    return (_MATCH_SQL.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", cand AS (SELECT a.unit, a.atelier, a.atelier_pos, f.path, f.file_pos "
            f"FROM ateliers a JOIN files f ON f.unit = a.unit AND {fits}), "
            f"last AS (SELECT unit, max({step}) AS n FROM {steps} GROUP BY unit), "
            "g AS (SELECT unit, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS own, CAST(NULL AS VARCHAR) AS got FROM last "
            "UNION ALL SELECT g.unit, g.k + 1, CASE WHEN count(c.path) = 0 THEN g.used ELSE list_append(g.used, "
            f"arg_min(c.{take}, c.{by})) END, any_value(c.{other}), arg_min(c.{take}, c.{by}) "
            "FROM g JOIN last ON last.unit = g.unit AND g.k < last.n LEFT JOIN cand c ON c.unit = g.unit "
            f"AND c.{step} = g.k + 1 AND NOT list_contains(g.used, c.{take}) GROUP BY g.unit, g.k, g.used), "
            + ("chosen AS (SELECT unit, own AS atelier, got AS path FROM g WHERE got IS NOT NULL) " if words
               else "chosen AS (SELECT unit, got AS atelier, own AS path FROM g WHERE got IS NOT NULL) "))


def _match_inputs(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("U"), F.floor(F.col("p_partkey") / UNIT_PARTS).cast("string")).alias("unit"), "p_name", "p_type", "p_brand")
    files = p.select("unit", F.concat(F.lit("MOV "), "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(".xlsx"))
                     .alias("file_name")).distinct()
    files = files.withColumn("path", F.concat_ws("/", "unit", "file_name")).withColumn(
        "file_pos", F.row_number().over(Window.partitionBy("unit").orderBy(F.md5("file_name"), "file_name")))
    words = F.split("p_name", " ")
    ateliers = p.select("unit", F.explode(F.concat(words, F.array(F.lower("p_type"), F.concat_ws(" ", F.lower("p_type"), words[0]))))
                        .alias("atelier")).distinct()
    ateliers = ateliers.withColumn("keyword", F.col("atelier")).withColumn(
        "atelier_pos", F.row_number().over(Window.partitionBy("unit").orderBy("atelier")))
    return cut_lineage(files, "unit-files"), cut_lineage(ateliers, "unit-ateliers")


@query("match_files", _greedy_sql(False) + "SELECT unit, atelier, path FROM chosen")
def match_files(spark, sf_dir):
    """Files in order, each takes its first free matching atelier."""
    files, ateliers = _match_inputs(spark, sf_dir)
    return M.assign(files, ateliers, "files_first")


@query("match_files_words", _greedy_sql(True) + "SELECT unit, atelier, path FROM chosen")
def match_files_words(spark, sf_dir):
    """Ateliers in order, each takes its first unused file (keyword or all its words)."""
    files, ateliers = _match_inputs(spark, sf_dir)
    return M.assign(files, ateliers, "ateliers_first")


@query("unmatched", _greedy_sql(True) + "SELECT unit, 'file' AS kind, file_name AS name FROM files "
       "WHERE path NOT IN (SELECT path FROM chosen) UNION ALL SELECT unit, 'atelier', atelier FROM ateliers "
       "WHERE unit || '/' || atelier NOT IN (SELECT unit || '/' || atelier FROM chosen)")
def unmatched(spark, sf_dir):
    """Files without an atelier and ateliers without a file."""
    files, ateliers = _match_inputs(spark, sf_dir)
    assigned = M.assign(files, ateliers, "ateliers_first")
    return M.unmatched(files, ateliers, assigned)


@query("match_counts", _greedy_sql(False) + "SELECT f.unit, count(*) AS n_files, (SELECT count(*) FROM chosen c WHERE c.unit = f.unit) "
       "AS n_matched FROM files f GROUP BY f.unit")
def match_counts(spark, sf_dir):
    """Files given and matched per unit."""
    files, ateliers = _match_inputs(spark, sf_dir)
    return M.match_counts(files, M.assign(files, ateliers, "files_first"))
