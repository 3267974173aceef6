"""Text cleaning, reference normalisation and string similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (Unicode White_Space
# plus the ASCII separators 0x1C-0x1F).  Spark's trim() only removes spaces,
# so the cleaning rules use this class in a regex instead.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# the same characters as a literal set, for btrim
WS_CHARS = "".join(chr(c) for c in [0x09, 0x0A, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_DIGIT_DOT_DIGIT = r"(?<=\p{Nd})\.(?=\p{Nd})"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Strip leading and trailing whitespace (Unicode aware, like str.strip):
    a character-set trim, no regex."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def normalize_ref(c) -> Column:
    """Reference key: stripped, and a dot between two digits becomes a comma.

    Digits are Unicode decimal digits (Arabic-Indic included).  Blank refs
    become NULL so that they never form a group key.
    """
    return ref_key(strip_text(c))


def ref_key(s: Column) -> Column:
    """``normalize_ref`` of a stripped text; the pattern runs only on texts
    that hold a dot."""
    return F.when(s != "", F.when(s.contains("."), F.regexp_replace(s, _DIGIT_DOT_DIGIT, ",")).otherwise(s))


def normalize_label(c) -> Column:
    """Header label: whitespace runs collapsed to one space, trimmed, lower."""
    s = F.regexp_replace(_c(c), f"{WS_CLASS}+", " ")
    return F.lower(strip_text(s))


def similarity(a, b) -> Column:
    """Edit-distance similarity in [0, 1] of lower-cased, trimmed texts.

    Equal texts (both empty included) give 1, one empty text gives 0,
    otherwise 1 - levenshtein / longer length.
    """
    s1 = F.lower(strip_text(F.coalesce(_c(a).cast("string"), F.lit(""))))
    s2 = F.lower(strip_text(F.coalesce(_c(b).cast("string"), F.lit(""))))
    n = F.greatest(F.length(s1), F.length(s2))
    return (F.when(s1 == s2, F.lit(1.0))
            .when((F.length(s1) == 0) | (F.length(s2) == 0), F.lit(0.0))
            .otherwise(F.lit(1.0) - F.levenshtein(s1, s2).cast("double") / n.cast("double")))


def sign_class(c) -> Column:
    """'positive' / 'negative' / '' by the sign of a difference (null -> '')."""
    d = F.coalesce(_c(c).cast("double"), F.lit(0.0))
    return F.when(d > 0, "positive").when(d < 0, "negative").otherwise("")


def format_2dp(c) -> Column:
    """Fixed two-decimal text; null or non-numeric becomes '0'."""
    v = F.expr(f"try_cast({_sql_of(c)} AS DOUBLE)") if isinstance(c, str) else _c(c).cast("double")
    # String.format prints a NULL as 'null' cut to the precision ('nu'), so
    # the NULL branch is explicit.
    return F.when(v.isNotNull() & ~F.isnan(v), F.format_string("%.2f", v)).otherwise(F.lit("0"))


def _sql_of(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(F.coalesce(_c(c).cast("string"), F.lit(""))).contains(needle.lower())
