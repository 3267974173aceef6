"""Column -> Column scalar functions (all built-in Spark expressions)."""

from ledgerlens.functions.text import (
    WS_CLASS, strip_text, normalize_ref, normalize_label, similarity,
    sign_class, format_2dp, contains_ci,
)
from ledgerlens.functions.numbers import (
    QTY, MONEY, coerce_number, coerce_locale_number, qty_or_zero, to_out,
)
from ledgerlens.functions.dates import (
    parse_iso, parse_dayfirst, parse_monthfirst, parse_by_order,
    excel_serial_to_date, month_start, next_month_start,
)

__all__ = [
    "WS_CLASS", "strip_text", "normalize_ref", "normalize_label", "similarity",
    "sign_class", "format_2dp", "contains_ci",
    "QTY", "MONEY", "coerce_number", "coerce_locale_number", "qty_or_zero", "to_out",
    "parse_iso", "parse_dayfirst", "parse_monthfirst", "parse_by_order",
    "excel_serial_to_date", "month_start", "next_month_start",
]
