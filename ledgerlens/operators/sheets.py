"""Sheet choice per workbook: candidate lists, keyword preference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import checked_broadcast


def sheet_from_candidates(sheets: DataFrame, jobs: DataFrame, job_keys: Sequence[str]) -> DataFrame:
    """First available sheet from each job's ordered candidate list.

    ``jobs(job_keys..., file_id, candidates ARRAY<STRING>)``; a candidate
    made of digits names a sheet by position.  Jobs without any available
    candidate keep a NULL sheet (reported by ``verify``).
    """
    c = jobs.select(*job_keys, "file_id", F.posexplode("candidates").alias("_cpos", "_cand"))
    by_pos = F.col("_cand").rlike(r"^[0-9]+$")
    s = sheets.alias("s")
    j = c.join(s, (c["file_id"] == F.col("s.file_id"))
               & ((F.col("s.sheet") == F.col("_cand"))
                  | (by_pos & (F.col("s.sheet_pos") == F.col("_cand").try_cast("int")))), "left")
    return (j.groupBy(*job_keys, c["file_id"])
            .agg(F.min_by(F.col("s.sheet"), F.when(F.col("s.sheet").isNotNull(), F.col("_cpos"))).alias("sheet")))


def sheet_by_keywords(sheets: DataFrame, keywords: Sequence[str], exact: bool = False) -> DataFrame:
    """Per workbook: the first keyword (in order) found in an upper-cased
    sheet name picks the first such sheet; otherwise the first sheet.
    ``exact`` compares whole names instead of substrings."""
    kw = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(k.upper()).alias("w")) for i, k in enumerate(keywords)])
    x = sheets.select("*", F.explode(kw).alias("_kw"))
    name = F.upper(F.col("sheet"))
    hit = (name == F.col("_kw.w")) if exact else name.contains(F.col("_kw.w"))
    pref = (x.where(hit).groupBy("file_id")
            .agg(F.min_by("sheet", F.struct(F.col("_kw.k"), F.col("sheet_pos"))).alias("_pref")))
    first = sheets.groupBy("file_id").agg(F.min_by("sheet", "sheet_pos").alias("_first"))
    return (first.join(pref, "file_id", "left")
            .select("file_id", F.coalesce("_pref", "_first").alias("sheet"),
                    F.col("_pref").isNotNull().alias("preferred")))


def restrict(grid: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen sheets only; extra key columns of ``chosen`` (such
    as the job) are carried onto the rows.  ``chosen`` has one row per
    (file, sheet, job): it is materialized so the planner broadcasts it
    while its size allows and the grid streams through unshuffled."""
    return grid.join(checked_broadcast(chosen.where(F.col("sheet").isNotNull()), "sheets"), ["file_id", "sheet"])
