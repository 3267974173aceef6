"""Messy-text renderings of the benchmark tables (the shapes ledger sheets
arrive in): padded refs, locale quantities, dates in several layouts.

Each rendering is a deterministic function of a row, chosen by a column of
that row (part key or line number), so the whole table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import read_table

NBSP = "\u00a0"


def _dec2(c: str):
    return F.col(c).cast("decimal(18,2)").cast("string")


def text_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: retail price (and label) as padded reference text."""
    p = read_table(spark, sf_dir, "part")
    price = _dec2("p_retailprice")
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "), price, F.lit("\t")))
           .when(k == 1, F.concat(F.lit(NBSP), price, F.lit(" ")))
           .when(k == 2, F.concat(F.lit("\t"), F.col("p_name"), F.lit(" "), price))
           .otherwise(F.concat(price, F.lit(NBSP + NBSP))))
    return p.select("p_partkey", "p_name", raw.alias("raw"))


def text_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: quantities / values as text with spaces, NBSP, decimal comma, junk."""
    li = read_table(spark, sf_dir, "lineitem")
    q, e = _dec2("l_quantity"), _dec2("l_extendedprice")
    k = F.col("l_linenumber") % 5
    raw = (F.when(k == 0, q)
           .when(k == 1, F.concat(F.lit(" "), e, F.lit(" ")))
           .when(k == 2, F.regexp_replace(e, r"\.", ","))
           .when(k == 3, F.regexp_replace(e, r"^([0-9]+)([0-9]{3})\.", "$1" + NBSP + "$2,"))
           .otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("d"))))
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"))


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ship dates rendered per line number: 1-2 d/M/yyyy, 3-4
    M/d/yyyy, 5 ISO, 6-7 Excel serial day numbers.  One 'file' per line
    number; row_idx is the order key."""
    li = read_table(spark, sf_dir, "lineitem")
    d = F.col("l_shipdate").cast("date")
    n = F.col("l_linenumber")
    raw = (F.when(n <= 2, F.date_format(d, "d/M/yyyy"))
           .when(n <= 4, F.date_format(d, "M/d/yyyy"))
           .when(n == 5, F.date_format(d, "yyyy-MM-dd"))
           .otherwise(F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")))
    return li.select(F.concat(F.lit("F"), n.cast("string")).alias("file_id"),
                     F.col("l_orderkey").alias("row_idx"), raw.alias("raw"), d.alias("ship_date"))
