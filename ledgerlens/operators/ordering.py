"""Display order of result lists, computed without a single-partition window.

``rank_within`` numbers rows 1..n inside each group following a total order.
A window ``row_number() OVER (PARTITION BY group ORDER BY ...)`` would put a
whole group (one atelier may hold a third of all rows) into one task.
Instead the rows are range-sorted across all partitions, each row gets its
position inside its partition, per-partition counts (one row per partition)
give prefix offsets, and each group's first global position is subtracted.
The sorted rows, with their partition and in-partition positions as
columns, are written once to the shared checkpoint folder so both passes
read the same order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import checked_broadcast, cut_lineage


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
                name: str = "rank") -> DataFrame:
    """Add a 1-based position ``name`` inside each group, by ``order_cols``.

    ``order_cols`` must make the order total (end with a unique key).
    """
    sorted_df = (df.orderBy(*[F.col(c).asc_nulls_first() for c in group_cols], *order_cols)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_local", F.monotonically_increasing_id()
                             - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sorted_df = cut_lineage(sorted_df, "ranked")
    # one row per partition: a size bounded by the partition count
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = offsets.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    numbered = (sorted_df.join(F.broadcast(offsets), "_pid")
                .withColumn("_g", F.col("_off") + F.col("_local")))
    if group_cols:
        # one row per group, written back so the planner broadcasts it by its
        # real size: the numbered rows are never shuffled by group (a hot
        # group would otherwise land in one task)
        starts = checked_broadcast(numbered.groupBy(*group_cols).agg(F.min("_g").alias("_g0")), "group-starts")
        cond = [numbered[c].eqNullSafe(starts[c]) for c in group_cols]
        numbered = numbered.join(starts, cond).drop(*[starts[c] for c in group_cols])
    else:
        numbered = numbered.withColumn("_g0", F.lit(0))
    return (numbered.withColumn(name, (F.col("_g") - F.col("_g0") + 1).cast("long"))
            .drop("_pid", "_local", "_off", "_g", "_g0"))


def discrepancy_order_signed() -> list[Column]:
    """Difference descending, then Ref (code-point order) as a tie-break."""
    return [F.col("Difference").desc(), F.col("Ref").asc()]


def discrepancy_order_abs(extra: Sequence[str] = ("job_idx",)) -> list[Column]:
    """|Difference| descending, then job and Ref."""
    return [F.abs(F.col("Difference")).desc(), *[F.col(c).asc() for c in extra], F.col("Ref").asc()]


def positioned(recon: DataFrame, orders: dict[str, str], keys: Sequence[str] = ("unit", "atelier", "status")) -> DataFrame:
    """``recon`` with ``position``, the place of a row in its list (per unit,
    atelier and status) as the unit's rule orders it, in one distributed rank
    for all units: ``orders`` gives 'abs' (|Difference| descending over all
    jobs) or 'signed' (job by job, Difference descending) by unit; matches
    stand job by job by Ref.  Ties stand by job and Ref."""
    by_abs = [u for u, o in orders.items() if o == "abs"]
    job = F.col("job_idx") if "job_idx" in recon.columns else F.lit(0)
    match, absolute = F.col("status") == "match", F.col("unit").isin(by_abs) if by_abs else F.lit(False)
    first = F.when(~match & absolute, F.lit(None).cast("int")).otherwise(job)
    size = F.when(match, F.lit(0.0)).when(absolute, F.abs("Difference")).otherwise(F.col("Difference"))
    ranked = recon.withColumn("_first", first).withColumn("_size", size).withColumn("_job", job)
    order = [F.col("_first").asc(), F.col("_size").desc(), F.col("_job").asc(), F.col("Ref").asc()]
    return rank_within(ranked, list(keys), order, "position").drop("_first", "_size", "_job")
