"""Job expansion: one atelier may run several (stock, ledger) jobs whose
results are appended (refs may repeat across jobs; ``job_idx`` keeps them
apart).  Jobs are rows of a small config DataFrame joined to the lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import strip_text


def jobs_frame(spark: SparkSession, jobs: Sequence[Sequence[str]]) -> DataFrame:
    """Nested config (one list of locations per job) -> (job_idx, location)."""
    rows = [(i, str(loc).strip()) for i, locs in enumerate(jobs) for loc in locs]
    return spark.createDataFrame(rows, "job_idx int, location string")


def expand_jobs(lines: DataFrame, jobs: DataFrame, col: str = "localisation") -> DataFrame:
    """Tag each line with every job whose location list contains it.

    The job table is configuration (a handful of rows), so it is broadcast.
    """
    j = F.broadcast(jobs)
    return (lines.join(j, strip_text(lines[col]) == j["location"])
            .drop("location"))
