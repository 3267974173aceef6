"""From located headers to typed snapshot / ledger lines.

``extract`` keeps the rows below each sheet's header, drops wholly blank
rows and picks the cells at the resolved positions.  The per-sheet header
table (one row per sheet) is joined to the grid, broadcast when its measured
size allows (``session.checked_broadcast``), so the grid is not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.columns import cell
from ledgerlens.session import checked_broadcast

KEYS = ("file_id", "sheet")


def extract(grid: DataFrame, header: DataFrame, roles: Mapping[str, Column],
            keys: Sequence[str] = KEYS, written: bool = False) -> DataFrame:
    """``header(keys..., header_idx, header)`` (``written``: a table read from
    storage, whose size the planner knows) and role -> position expression
    over ``header`` give ``(keys..., row_idx, <role>...)`` raw text cells,
    plus ``<role>_pos`` for diagnostics."""
    pos = header.select(*keys, "header_idx", *[e.alias(f"{r}_pos") for r, e in roles.items()])
    if not written:
        pos = checked_broadcast(pos)
    body = grid.join(pos, list(keys)).where(F.col("row_idx") > F.col("header_idx"))
    body = body.where(F.array_max("cells").isNotNull())  # some cell is not empty
    return body.select(*keys, "row_idx", *[cell(F.col(f"{r}_pos")).alias(r) for r in roles],
                       *[f"{r}_pos" for r in roles])


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each computed once a row.
    A filter on a column of a plain ``select`` is moved below it, with the
    column's expression written out at every use; not below a generator."""
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))


def missing_columns(header: DataFrame, roles: Mapping[str, Column], required: Sequence[str],
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Diagnostics rows for sheets where a required role was not resolved."""
    pos = header.select(*keys, "header", *[e.alias(f"{r}_pos") for r, e in roles.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(f"{r}_pos").isNull(), F.lit(r)) for r in required]))
    return (pos.where(F.size(missing) > 0)
            .select(*keys, F.lit("error").alias("severity"), F.lit("MISSING_COLUMN").alias("code"),
                    F.concat(F.lit("Could not find "), F.array_join(missing, "/"), F.lit(" column. Available: "),
                             F.array_join(F.col("header"), ", ", "")).alias("message")))
