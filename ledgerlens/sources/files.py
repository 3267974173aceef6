"""File listings as data: names, extensions, snapshot periods, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Snapshot file-name pattern ("STOCK 11-2025.xlsx", "stock_1 2025")
# and the accepted input extensions.
STOCK_PERIOD_RE = r"(?i)stock\s*(\d{1,2})\s*[-_\s]\s*(\d{4})"
INPUT_EXTENSIONS = ("xlsx", "xls", "csv")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def stock_period(name: Column) -> Column:
    """(month 'MM', year) parsed from a snapshot file name, or NULL."""
    m = F.regexp_extract(name, STOCK_PERIOD_RE, 1)
    y = F.regexp_extract(name, STOCK_PERIOD_RE, 2)
    mi, yi = m.try_cast("int"), y.try_cast("int")
    ok = (m != "") & (mi >= 1) & (mi <= 12) & (yi > 0)
    return F.when(ok, F.struct(F.lpad(mi.cast("string"), 2, "0").alias("month"), yi.alias("year")))


def is_stock_file(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("stock") & ~low.contains("mov")


def classify_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Keep spreadsheet / CSV inputs once per path, tagged stock or movement."""
    f = files.dropDuplicates([path_col])
    name = base_name(F.col(path_col))
    f = f.select(path_col, name.alias("file_name"))
    f = f.withColumn("ext", extension(F.col("file_name")))
    f = f.where(F.col("ext").isin(*INPUT_EXTENSIONS))
    return f.withColumn("kind", F.when(is_stock_file(F.col("file_name")), "stock").otherwise("movement"))


def with_period(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    p = stock_period(F.col(name_col))
    return files.withColumn("month", p["month"]).withColumn("year", p["year"]).withColumn(
        "period", F.when(p.isNotNull(), F.make_date(p["year"], p["month"].cast("int"), F.lit(1))))


def previous_snapshot(files: DataFrame) -> DataFrame:
    """Each dated snapshot with the snapshot of the month before (or NULL).

    Month arithmetic on parsed dates: 'STOCK 1-2025' never matches inside
    'STOCK 11-2025'.
    """
    cur = files.where(F.col("period").isNotNull()).alias("c")
    prev = files.where(F.col("period").isNotNull()).select(
        F.col("file_name").alias("prev_file"), F.col("period").alias("_pp"))
    return (cur.join(prev, F.add_months(F.col("c.period"), -1) == F.col("_pp"), "left")
            .select("c.file_name", "c.period", "prev_file"))


def assign_snapshots(files: DataFrame, year: int, month: int, keys=("unit",)) -> DataFrame:
    """Role of each snapshot file for a target period: 'current' when its
    name says the target month, 'previous' for the month before; files whose
    name carries no period fill the free roles in listing order (current
    first, then previous).  ``files(keys..., path, file_name, file_pos)``;
    a unit's snapshot listing is small, so the window below stays small."""
    from pyspark.sql import Window

    f = with_period(files)
    target = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    role = (F.when(F.col("period") == target, "current")
            .when(F.col("period") == F.add_months(target, -1), "previous"))
    f = f.withColumn("role", role)
    named = f.where(F.col("role").isNotNull())
    taken = named.groupBy(*keys).agg(F.collect_set("role").alias("_taken"))
    rest = f.where(F.col("role").isNull()).join(taken, list(keys), "left")
    rest = rest.withColumn("_free", F.filter(F.array(F.lit("current"), F.lit("previous")),
                                             lambda r: ~F.coalesce(F.array_contains("_taken", r), F.lit(False))))
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("file_pos")))
    rest = rest.withColumn("role", F.try_element_at("_free", F.col("_n").cast("int")))
    cols = [*keys, "path", "file_name", "role"]
    return named.select(*cols).unionByName(rest.where(F.col("role").isNotNull()).select(*cols))
