"""One entry point for ledger / snapshot files of any supported type.

``.xlsx`` files go to the workbook parser, ``.csv`` files to the CSV grid
reader, and the two grids are unioned (same schema, ``file_id`` = full path).
A workbook of the old binary format (``.xls``) or a damaged one is kept as a
marker row, which ``unreadable`` turns into a table; other extensions are
ignored, as the file classifier does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checked_broadcast, cut_lineage
from ledgerlens.sources.csv_grid import NOTED, csv_grid, read_lines
from ledgerlens.sources.xlsx import UNREADABLE, local_path, parse_workbooks


def read_files(spark: SparkSession, paths) -> DataFrame:
    """Grid rows, marker rows included, of every file matching ``paths``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS]*").load(paths)
             .select(local_path(F.col("path")).alias("path"), "content"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    old = files.where(ext == "xls").select(
        F.col("path").alias("file_id"), F.lit(UNREADABLE).alias("sheet_pos"), F.lit("").alias("sheet"),
        F.lit(-1).cast("bigint").alias("row_idx"), F.array(F.lit("unsupported file type .xls")).alias("cells"))
    return (parse_workbooks(files.where(ext == "xlsx")).unionByName(csv_grid(read_lines(spark, paths)))
            .unionByName(old))


def readable(grid: DataFrame) -> DataFrame:
    """The rows of files that could be read whole."""
    bad = checked_broadcast(unreadable(grid).select("file_id").distinct(), "unreadable")
    return grid.where(F.col("sheet_pos") >= 0).join(bad, "file_id", "left_anti")


def unreadable(grid: DataFrame) -> DataFrame:
    """(file_id, message) of the files that could not be read."""
    return grid.where(F.col("sheet_pos") == UNREADABLE).select("file_id", F.element_at("cells", 1).alias("message"))


def noted(grid: DataFrame) -> DataFrame:
    """(file_id, message) of the files that were read with a note."""
    return grid.where(F.col("sheet_pos") == NOTED).select("file_id", F.element_at("cells", 1).alias("message"))


def read_grid(spark: SparkSession, paths) -> DataFrame:
    """Grid rows of every readable spreadsheet / CSV file matching ``paths``."""
    return readable(cut_lineage(read_files(spark, paths), "grid-files"))
