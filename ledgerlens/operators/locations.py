"""Location rules: which snapshot / ledger lines belong to an atelier.

Location lists are configuration.  A literal list becomes ``isin`` (pushed to
the scan); per-atelier lists and (LOCAL, LOCALISATION) pairs are small
configuration DataFrames, broadcast into left-semi joins.  The implicit list
(every distinct snapshot location) is derived from the data, so it goes
through ``session.checked_broadcast`` and is broadcast only by its real size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import strip_text
from ledgerlens.session import checked_broadcast


def _clean(values: Sequence[str] | None) -> list[str]:
    """Config values are stripped; blanks are dropped (a padded config entry
    must still equal the stripped data)."""
    return [str(v).strip() for v in (values or []) if str(v).strip()]


def location_in(df: DataFrame, include: Sequence[str] | None, col: str = "localisation") -> DataFrame:
    """Keep rows whose stripped location is listed; an empty list keeps all."""
    inc = _clean(include)
    if not inc:
        return df
    return df.where(strip_text(col).isin(inc))


def location_not_in(df: DataFrame, exclude: Sequence[str] | None, col: str = "localisation") -> DataFrame:
    exc = _clean(exclude)
    if not exc:
        return df
    loc = strip_text(col)
    return df.where(loc.isNotNull() & ~loc.isin(exc))


def location_pair_in(df: DataFrame, pairs: Sequence[tuple[str, str]],
                     local_col: str = "local", loc_col: str = "localisation") -> DataFrame:
    """Keep rows whose (LOCAL, LOCALISATION) pair is listed; empty keeps all."""
    clean = [(str(a).strip(), str(b).strip()) for a, b in pairs]
    if not clean:
        return df
    rules = df.sparkSession.createDataFrame(clean, "_l string, _p string")
    cond = (strip_text(df[local_col]) == rules["_l"]) & (strip_text(df[loc_col]) == rules["_p"])
    return df.join(F.broadcast(rules), cond, "left_semi")


def location_rules_semi(df: DataFrame, rules: DataFrame, keys: Sequence[str],
                        col: str = "localisation") -> DataFrame:
    """Per-atelier include lists: ``rules(keys..., location)`` semi-join."""
    cond = [df[k] == rules[k] for k in keys] + [strip_text(df[col]) == rules["location"]]
    return df.join(F.broadcast(rules), cond, "left_semi")


def implicit_selection(stock: DataFrame, mov: DataFrame, include: Sequence[str] | None = None,
                       exclude: Sequence[str] | None = None, keys: Sequence[str] = (),
                       stock_col: str = "localisation", mov_col: str | None = "localisation"
                       ) -> tuple[DataFrame, DataFrame]:
    """Include list (configured, or every distinct stock location) minus the
    exclusions, applied to the snapshot and the ledger.

    The ledger also drops excluded and blank locations.  With ``mov_col``
    None (no location column in the ledger) the ledger is kept whole.
    """
    exc = _clean(exclude)
    inc = _clean(include)
    if inc:
        inc = [v for v in inc if v not in set(exc)]
        s = location_in(stock, inc, stock_col) if inc else stock.where(F.lit(False))
        if mov_col is None:
            return s, mov
        m = location_in(location_not_in(mov, exc, mov_col), inc, mov_col) if inc else mov.where(F.lit(False))
        return s, m
    # implicit: all locations present in the snapshot, minus exclusions
    locs = (stock.select(*keys, strip_text(stock_col).alias("location"))
            .where(F.col("location").isNotNull()).distinct())
    if exc:
        locs = locs.where(~F.col("location").isin(exc))
    locs = checked_broadcast(locs, "locations")
    s = stock.alias("s").join(locs.alias("l"), [F.col(f"s.{k}") == F.col(f"l.{k}") for k in keys]
                              + [strip_text(F.col(f"s.{stock_col}")) == F.col("l.location")], "left_semi")
    if mov_col is None:
        return s, mov
    m = location_not_in(mov, exc, mov_col)
    m = m.where(strip_text(mov_col) != "")
    m = m.alias("m").join(locs.alias("l"), [F.col(f"m.{k}") == F.col(f"l.{k}") for k in keys]
                          + [strip_text(F.col(f"m.{mov_col}")) == F.col("l.location")], "left_semi")
    return s, m
