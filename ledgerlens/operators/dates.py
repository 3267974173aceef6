"""Per-file date handling: US / EU / ISO detection and Excel serial gating.

Both decisions are per (file, sheet) column and are computed with
hash aggregates over all values (the order over the distinct texts with their
counts), then joined back to the lines (one row per file, broadcast when its
measured size allows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import (SERIAL_MEDIAN_HIGH, SERIAL_MEDIAN_LOW, excel_serial_to_date,
                                        parse_by_order, parse_dayfirst)
from ledgerlens.functions.text import strip_text
from ledgerlens.session import checked_broadcast, cut_lineage

# day/month/year and ISO shapes used for the order signals.
MD_RE = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
ISO_RE = r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}"


def dictionary(df: DataFrame, group: Sequence[str], value_col: str) -> DataFrame:
    """(group..., value, _n): the distinct texts of every column with their
    counts, counted map-side first and written once.  A ledger repeats a few
    thousand days over any number of lines, so what follows (strip, patterns,
    casts) runs once per text instead of once per line."""
    return cut_lineage(df.where(F.col(value_col).isNotNull()).groupBy(*group, value_col).agg(F.count(F.lit(1)).alias("_n")), "dates")


def detect_date_order(df: DataFrame, group: Sequence[str], value_col: str) -> DataFrame:
    """(group..., date_order, n_us, n_eu, n_iso, n_values) per column.

    All non-null values vote, stripped, blanks not counted.  Clear day>12 /
    month>12 signals decide; ties fall to 'eu' unless at least half the values
    are ISO.
    """
    return _vote(dictionary(df, group, value_col), group, value_col)


def _vote(texts: DataFrame, group: Sequence[str], value_col: str) -> DataFrame:
    sample = texts.select(*group, "_n", strip_text(F.col(value_col).cast("string")).alias("_v"))
    v = F.col("_v")
    filled = v != ""
    iso = filled & v.rlike(ISO_RE)
    md = filled & ~iso & v.rlike(MD_RE)
    a = F.regexp_extract(v, MD_RE, 1).try_cast("int")
    b = F.regexp_extract(v, MD_RE, 2).try_cast("int")
    # blank values stay in the rows so that a column of blanks still
    # yields a row ('unknown'); they are not counted
    times = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    counts = sample.groupBy(*group).agg(
        times(filled).alias("n_values"), times(iso).alias("n_iso"), times(md & (a > 12) & (b <= 12)).alias("n_eu"),
        times(md & (b > 12) & (a <= 12)).alias("n_us"))
    us, eu, iso_n, n = F.col("n_us"), F.col("n_eu"), F.col("n_iso"), F.col("n_values")
    fmt = (F.when(n == 0, "unknown")
           .when((us > eu) & (us > 0), "us")
           .when((eu > us) & (eu > 0), "eu")
           .when((iso_n > 0) & (iso_n >= n * 0.5), "iso")
           .otherwise("eu"))
    return counts.select(*group, fmt.alias("date_order"), "n_us", "n_eu", "n_iso", "n_values")


#: Texts up to which parsed dates are joined back; beyond it (columns with
#: times of day, say) every line is parsed where it stands.
DICTIONARY_ROWS = 100_000


def parse_dates_auto(df: DataFrame, group: Sequence[str], value_col: str,
                     out: str = "mov_date") -> DataFrame:
    """Parse each column by its detected order."""
    texts = dictionary(df, group, value_col)
    det = checked_broadcast(_vote(texts, group, value_col).select(*group, "date_order"))
    j = df.join(det, list(group), "left").fillna("unknown", ["date_order"])
    if texts.count() > DICTIONARY_ROWS:
        return j.withColumn(out, parse_by_order(F.col(value_col), F.col("date_order")))
    dates = texts.join(det, list(group)).select(*group, value_col, parse_by_order(F.col(value_col), F.col("date_order")).alias(out))
    return j.join(checked_broadcast(dates), [*group, value_col], "left").select(*j.columns, out)


def serial_date_columns(df: DataFrame, group: Sequence[str], value_col: str) -> DataFrame:
    """(group..., is_serial): all values numeric and median in [20000, 60000].

    The median test is exact without collecting values: with n values, lo of
    them below 20000 and hi above 60000, the median is inside unless lo or hi
    reaches the middle; when a middle pair straddles a bound (even n) the two
    middle values are the max below / min above that bound.
    """
    return _serial(dictionary(df, group, value_col), group, value_col)


def _serial(texts: DataFrame, group: Sequence[str], value_col: str) -> DataFrame:
    s = strip_text(F.col(value_col).cast("string"))
    x = F.when(s != "", s).try_cast("decimal(38,10)").cast("double")
    lo_b, hi_b = float(SERIAL_MEDIAN_LOW), float(SERIAL_MEDIAN_HIGH)
    times = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    agg = (texts.where(s != "")
           .groupBy(*group).agg(
               F.sum("_n").alias("n"), times(x.isNotNull()).alias("n_num"),
               times(x < lo_b).alias("lo"), times(x > hi_b).alias("hi"),
               F.max(F.when(x < lo_b, x)).alias("a_lo"), F.min(F.when(x >= lo_b, x)).alias("b_lo"),
               F.max(F.when(x <= hi_b, x)).alias("a_hi"), F.min(F.when(x > hi_b, x)).alias("b_hi")))
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    odd = (n % 2) == 1
    half = (n / 2).cast("long")
    k = ((n + 1) / 2).cast("long")
    ge_low = F.when(odd, lo < k).otherwise(
        F.when(lo <= half - 1, True).when(lo >= half + 1, False)
        .otherwise((F.col("a_lo") + F.col("b_lo")) / 2 >= lo_b))
    le_high = F.when(odd, hi < k).otherwise(
        F.when(hi <= half - 1, True).when(hi >= half + 1, False)
        .otherwise((F.col("a_hi") + F.col("b_hi")) / 2 <= hi_b))
    ok = (F.col("n_num") == n) & (n > 0) & ge_low & le_high
    return agg.select(*group, F.coalesce(ok, F.lit(False)).alias("is_serial"))


def coerce_dates(df: DataFrame, group: Sequence[str], value_col: str, out: str = "mov_date") -> DataFrame:
    """Serial numbers where the column passes the gate, else day-first text."""
    texts = dictionary(df, group, value_col)
    gate = checked_broadcast(_serial(texts, group, value_col))
    gated = lambda rows: rows.join(gate, list(group), "left").fillna(False, ["is_serial"])
    s = strip_text(F.col(value_col).cast("string"))
    num = F.when(s != "", s).try_cast("decimal(38,10)").cast("double")
    date = F.when(F.col("is_serial"), excel_serial_to_date(num)).otherwise(parse_dayfirst(F.col(value_col)))
    j = gated(df)
    if texts.count() > DICTIONARY_ROWS:
        return j.withColumn(out, date)
    dates = gated(texts).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(group)], F.col(value_col).alias("_text"), date.alias(out))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(group)]
    return j.join(checked_broadcast(dates), [*same, F.col(value_col) == F.col("_text")], "left").select(*j.columns, out)
