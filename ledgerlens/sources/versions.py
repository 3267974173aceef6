"""Versions of snapshots and report selections: an append-only Parquet table.

Every ``append`` is one version; nothing is rewritten.  A version holds rows of
one or several (unit, period); of a (unit, period) the latest version counts,
or the latest up to a given one, so that a run can be repeated as it was.  A
closing snapshot becomes the next period's opening (``openings``).

The table is partitioned by period and version: a read prunes to the folders
it needs.  One writer appends at a time, as a closing is made by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checked_broadcast

PERIOD = "yyyy-MM"


def period(year: int, month: int) -> str:
    return f"{year:04d}-{month:02d}"


def next_period(c: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(c, F.lit("-01"))), 1), PERIOD)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("period", F.col("period").cast("string")).withColumn("version", F.col("version").cast("int"))


def append(rows: DataFrame, path: str) -> int:
    """Add ``rows(unit, period, ...)`` as the next version; its number."""
    spark = rows.sparkSession
    last = (_table(spark, path).agg(F.max("version")).first()[0] or 0) if _exists(spark, path) else 0
    rows.withColumn("version", F.lit(last + 1)).write.mode("append").partitionBy("period", "version").parquet(path)
    return last + 1


def as_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of every (unit, period) in its latest version, or its latest
    one up to ``version``."""
    t = _table(spark, path)
    if version is not None:
        t = t.where(F.col("version") <= version)
    # one row per unit and period
    latest = checked_broadcast(t.groupBy("unit", "period").agg(F.max("version").alias("version")), "versions")
    return t.join(latest, ["unit", "period", "version"])


def openings(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The closings of ``as_of`` as openings: ``period`` is the one after."""
    return as_of(spark, path, version).withColumn("period", next_period(F.col("period")))
