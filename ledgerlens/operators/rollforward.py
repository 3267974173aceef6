"""Opening-balance roll-forward: closing snapshot vs opening + period ledger.

Expected_End = round(opening + period movement, 2) per Ref; the comparison
is closing vs expected with the 0.02 tolerance rule.  All three sides are
tagged, unioned and summed in one ``groupBy`` (one shuffle), which gives the
same rows as the two nested full outer joins.  A missing opening snapshot is
simply an empty side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import QTY
from ledgerlens.operators.reconcile import finish, sum_round2

TOLERANCE = 0.02


def rollforward(closing: DataFrame, mov: DataFrame, opening: DataFrame | None = None,
                keys: tuple[str, ...] = (), mov_round: int | None = 2,
                tolerance: float = TOLERANCE) -> DataFrame:
    cols = [*keys, "ref"]
    null = F.lit(None).cast(QTY)
    q = F.col("qty").cast(QTY)
    mq = F.round(F.coalesce(q, F.lit(0).cast(QTY)), mov_round) if mov_round is not None else q
    parts = [closing.select(*cols, q.alias("c"), null.alias("o"), null.alias("m")),
             mov.select(*cols, null.alias("c"), null.alias("o"), mq.alias("m"))]
    if opening is not None:
        parts.append(opening.select(*cols, null.alias("c"), q.alias("o"), null.alias("m")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    agg = (u.where(F.col("ref").isNotNull())
           .groupBy(*keys, F.col("ref").alias("Ref"))
           .agg(sum_round2(F.col("c")).alias("Stock_Qty"),
                sum_round2(F.col("o")).alias("_open"),
                sum_round2(F.col("m")).alias("_mov")))
    agg = agg.withColumn("Calc_Mov_Qty", F.round(F.col("_open") + F.col("_mov"), 2))
    return finish(agg, keys, tolerance, round_diff=True)
