"""Typed line adapters over the benchmark parquet tables.

The reconciliation engine consumes *line* DataFrames
(``ref, qty, mov_date, local, localisation`` plus grouping keys).  These
adapters derive them from the star-schema tables so that every query's work
grows with the data:

* ``mov_lines``   - lineitem as a movement ledger: ref = order key,
  qty = quantity, date = ship date, local = line status, localisation =
  return flag.
* ``stock_lines`` - the same lines outside location 'R' as a snapshot.
* ``value_lines`` - per-line net value (extended price x (1 - discount)).
* ``part_diff``   - per part: quantity at 'A' minus quantity at 'N'.

Only the columns a query needs are selected, so the parquet scan reads a
pruned schema and date predicates are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import QTY

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mov_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("ref"),
        F.col("l_quantity").cast(QTY).alias("qty"),
        F.col("l_shipdate").cast("date").alias("mov_date"),
        F.col("l_linestatus").alias("local"),
        F.col("l_returnflag").alias("localisation"),
    )


def stock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mov_lines(spark, sf_dir).where(F.col("localisation") != "R")


def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mov_lines with unit = line status and atelier = return flag."""
    return mov_lines(spark, sf_dir).select(
        F.col("local").alias("unit"), F.col("localisation").alias("atelier"), "*")


def value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-line net value as exact decimals (2 dp x 2 dp = 4 dp)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("ref"),
        (F.col("l_extendedprice").cast(QTY) * (F.lit(1) - F.col("l_discount").cast(QTY)))
        .cast(QTY).alias("qty"),
    )


def part_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-part discrepancy list: Ref text and Difference (A minus N)."""
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    q = F.col("l_quantity").cast(QTY)
    per_part = (li.where(F.col("l_returnflag").isin("A", "N"))
                .groupBy("l_partkey")
                .agg(F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", q)), F.lit(0)), 2).alias("a"),
                     F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "N", q)), F.lit(0)), 2).alias("n")))
    return (per_part.join(part, per_part.l_partkey == part.p_partkey)
            .select(F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("Ref"),
                    (F.col("a") - F.col("n")).alias("Difference")))
