"""Period filters on the movement date.

Each is one range predicate on the date column so Catalyst folds the bounds
to literals and pushes them into the Parquet scan (row-group pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import month_start, next_month_start


def cumulative_cutoff(df: DataFrame, year: int, month: int, date_col: str = "mov_date",
                      has_date: bool = True) -> DataFrame:
    """Everything up to the end of (year, month); NULL dates are dropped.

    Same as 'earlier year, or this year and month <= m'.  When the ledger has
    no date column at all, nothing is filtered.
    """
    if not has_date:
        return df
    return df.where(F.col(date_col) < next_month_start(year, month))


def exact_month(df: DataFrame, year: int, month: int, date_col: str = "mov_date") -> DataFrame:
    """Only rows dated inside (year, month)."""
    d = F.col(date_col)
    return df.where((d >= month_start(year, month)) & (d < next_month_start(year, month)))


def require_date(df: DataFrame, date_col: str = "mov_date") -> DataFrame:
    return df.where(F.col(date_col).isNotNull())
