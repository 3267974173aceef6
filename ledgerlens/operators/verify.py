"""Diagnostics as data: configuration lookups, file checks, blank refs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import checked_broadcast


def unknown_ateliers(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested (unit, atelier) without a configuration row -> error rows."""
    k = F.broadcast(known.select("unit", "atelier").distinct())
    miss = requested.select("unit", "atelier").distinct().join(k, ["unit", "atelier"], "left_anti")
    return miss.select("unit", "atelier", F.lit("error").alias("severity"),
                       F.lit("UNKNOWN_ATELIER").alias("code"),
                       F.concat(F.lit("Unknown atelier: "), F.col("atelier")).alias("message"))


def verification(grid: DataFrame, jobs: DataFrame, names: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """A row per matched file: which sheet was looked at, its columns, the ref,
    quantity and date columns found, and the errors.

    ``jobs(unit, atelier, file_id, expected_sheets ARRAY<STRING>)``;
    ``names(unit, date, ref, quantity)``: the header names of the units, in
    order of preference; ``broken(file_id, message)``: files that could not be
    read.  The first expected sheet that the workbook has is looked at; if it
    has none of them that is an error, and its first sheet is looked at.  The
    header is the first row with a date name, else the first row.  A missing
    ref or quantity column is an error, a missing date column is not.
    """
    from ledgerlens.operators import headers as H
    from ledgerlens.sources.grids import sheets_of

    avail = sheets_of(grid).groupBy("file_id").agg(  # bounded by a workbook's sheets
        F.sort_array(F.collect_set("sheet")).alias("available_sheets"), F.min_by("sheet", "sheet_pos").alias("_first"))
    j = jobs.join(F.broadcast(names), "unit").join(avail, "file_id", "left")  # names: configuration
    hit = F.get(F.filter("expected_sheets", lambda s: F.array_contains("available_sheets", s)), F.lit(0))
    j = checked_broadcast(j.withColumn("_hit", hit).withColumn("checked_sheet", F.coalesce("_hit", "_first")), "verified-files")
    keys = ["file_id", "sheet", "unit", "atelier"]
    rows = grid.join(j.select("file_id", F.col("checked_sheet").alias("sheet"), "unit", "atelier", F.col("date").alias("_dates")), ["file_id", "sheet"])
    hdr = H.header_by_names(rows, "_dates", keys).select("file_id", "unit", "atelier", "header")
    j = j.join(hdr, ["file_id", "unit", "atelier"], "left")
    first = lambda c: F.get(F.filter(c, lambda a: F.array_contains("header", a)), F.lit(0))
    j = j.select("*", *[first(c).alias(f"detected_{d}") for c, d in (("ref", "ref"), ("quantity", "qty"), ("date", "date"))])
    read = F.col("available_sheets").isNotNull()
    if broken is not None:
        j = j.join(checked_broadcast(broken.groupBy("file_id").agg(F.min("message").alias("_message")), "broken"), "file_id", "left")
    else:
        j = j.withColumn("_message", F.lit(None).cast("string"))
    errors = F.array_compact(F.array(
        F.when(~read, F.coalesce("_message", F.lit("no sheet could be read"))),
        F.when(read & F.col("_hit").isNull() & (F.size("expected_sheets") > 0),
               F.concat(F.lit("Sheet '"), F.get("expected_sheets", F.lit(0)), F.lit("' not found"))),
        F.when(read & F.col("detected_ref").isNull(), F.lit("Reference column not found")),
        F.when(read & F.col("detected_qty").isNull(), F.lit("Quantity column not found"))))
    none = F.array().cast("array<string>")
    return j.select("unit", "atelier", F.col("file_id").alias("filename"), (F.size(errors) == 0).alias("valid"), errors.alias("errors"),
                    F.coalesce("available_sheets", none).alias("available_sheets"),
                    F.coalesce(F.filter("header", lambda x: x.isNotNull()), none).alias("available_columns"),
                    "expected_sheets", "checked_sheet", "detected_ref", "detected_qty", "detected_date")


def blank_ref_diagnostics(lines: DataFrame, keys) -> DataFrame:
    """Lines whose ref is blank are excluded from the sums; count them."""
    return (lines.where(F.col("ref").isNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col("qty"), F.lit(0))).alias("_q"))
            .select(F.concat_ws("/", *keys).alias("scope"), F.lit("warning").alias("severity"),
                    F.lit("BLANK_REF").alias("code"),
                    F.format_string("%d line(s) without reference, quantity %s", F.col("_n"),
                                    F.col("_q").cast("string")).alias("message")))


def missing_inputs(units: DataFrame, snapshots: DataFrame, ledgers: DataFrame) -> DataFrame:
    """A unit needs a snapshot and at least one matched ledger."""
    s = snapshots.select("unit").distinct().withColumn("_s", F.lit(True))
    m = ledgers.select("unit").distinct().withColumn("_m", F.lit(True))
    u = units.select("unit").distinct().join(s, "unit", "left").join(m, "unit", "left")
    return u.where(F.col("_s").isNull() | F.col("_m").isNull()).select(
        F.col("unit").alias("scope"), F.lit("error").alias("severity"), F.lit("MISSING_INPUT").alias("code"),
        F.when(F.col("_s").isNull(), "no stock snapshot").otherwise("no matched ledger file").alias("message"))
