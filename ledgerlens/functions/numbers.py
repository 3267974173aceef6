"""Quantity coercion.

Quantities are summed as DECIMAL(28,4) so that sums do not depend on the
shuffle order and rounding is HALF_UP everywhere; outputs are cast to DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerlens.functions.text import WS_CLASS, strip_text

QTY = DecimalType(28, 4)
MONEY = DecimalType(18, 2)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_number(c) -> Column:
    """Lenient numeric text -> DECIMAL(28,4); anything unparsable -> NULL.

    Text such as '12d' or 'Infinity' is NULL (a DOUBLE cast would accept the
    first), as are blanks.
    """
    s = strip_text(_c(c).cast("string"))
    return s.try_cast(QTY)


def coerce_locale_number(c) -> Column:
    """Locale text ('1 234,5', NBSP thousands) -> DECIMAL(28,4), bad -> 0."""
    s = _c(c).cast("string")
    s = F.regexp_replace(s, r"[\x{A0} ]", "")
    s = F.regexp_replace(s, ",", ".")
    return F.coalesce(coerce_number(s), F.lit(0).cast(QTY))


def qty_or_zero(c) -> Column:
    """Coerced quantity with NULL replaced by 0."""
    return F.coalesce(coerce_number(c), F.lit(0).cast(QTY))


def to_out(c) -> Column:
    """Final numeric output type shared with the SQL oracle."""
    return _c(c).cast("double")


__all__ = ["QTY", "MONEY", "WS_CLASS", "coerce_number", "coerce_locale_number",
           "qty_or_zero", "to_out"]
