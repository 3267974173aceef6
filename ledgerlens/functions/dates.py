"""Date parsing for ledger text: ISO, day-first, month-first, Excel serials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import strip_text

# Accepted textual layouts, as full-string shapes.  ISO is
# always tried first; day / month take one or two digits (day 1-31, month
# 1-12) and the year exactly four, so that '25' is never read as year 25.
#   ISO         yyyy-M-d, yyyy/M/d, yyyy-M-d H:m:s, yyyy-M-dTH:m:s
#   day-first   d/M/yyyy, d-M-yyyy, d.M.yyyy, d/M/yyyy H:m:s, d/M/yyyy H:m
#   month-first M/d/yyyy, M-d-yyyy, M/d/yyyy H:m:s, M/d/yyyy H:m
_D = "(0?[1-9]|[12][0-9]|3[01])"
_M = "(0?[1-9]|1[0-2])"
_Y = "[0-9]{4}"
_HM = "([01]?[0-9]|2[0-3]):[0-5]?[0-9]"
_HMS = f"{_HM}:[0-5]?[0-9]"
ISO_FULL = f"^{_Y}(-{_M}-{_D}([ T]{_HMS})?|/{_M}/{_D})$"
DMY_FULL = rf"^{_D}(/{_M}/{_Y}( {_HM}(:[0-5]?[0-9])?)?|-{_M}-{_Y}|\.{_M}\.{_Y})$"
MDY_FULL = f"^{_M}(/{_D}/{_Y}( {_HM}(:[0-5]?[0-9])?)?|-{_D}-{_Y})$"
# the first three numbers of a matched value, rewritten as year-month-day
_FIRST3 = "^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+).*$"
# Excel's day zero; serial day numbers count from here.
EXCEL_EPOCH = "1899-12-30"
SERIAL_MEDIAN_LOW, SERIAL_MEDIAN_HIGH = 20000, 60000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stripped(c) -> Column:
    """The text of a cell; a blank one has no layout's shape."""
    return strip_text(_c(c).cast("string"))


def _layout(s: Column, shape: str, ymd: str) -> Column:
    """A value of the given shape as a DATE: one full-string regex test, one
    rewrite to year-month-day and a cast that yields NULL for impossible
    days (30 February); no parser runs on values of other shapes."""
    return F.when(s.rlike(shape), F.regexp_replace(s, _FIRST3, ymd).try_cast("date"))


def parse_iso(c) -> Column:
    return _layout(_stripped(c), ISO_FULL, "$1-$2-$3")


def parse_dayfirst(c) -> Column:
    """Day-first text date (ISO first); blank or unparsable -> NULL."""
    s = _stripped(c)
    return F.coalesce(_layout(s, ISO_FULL, "$1-$2-$3"), _layout(s, DMY_FULL, "$3-$2-$1"))


def parse_monthfirst(c) -> Column:
    s = _stripped(c)
    return F.coalesce(_layout(s, ISO_FULL, "$1-$2-$3"), _layout(s, MDY_FULL, "$3-$1-$2"))


def parse_by_order(c, order: Column) -> Column:
    """Parse by a detected order: 'us' and 'iso' columns are read month-first
    (non-ISO values included), 'eu' and 'unknown' day-first; ISO text always
    parses as ISO."""
    return F.when(order.isin("us", "iso"), parse_monthfirst(c)).otherwise(parse_dayfirst(c))


def excel_serial_to_date(num: Column) -> Column:
    """Excel serial day number -> DATE (whole days from 1899-12-30)."""
    return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.floor(num).cast("int"))


def month_start(year: int, month: int) -> Column:
    return F.make_date(F.lit(year), F.lit(month), F.lit(1))


def next_month_start(year: int, month: int) -> Column:
    return F.add_months(month_start(year, month), 1)
