"""Column resolution: header cells -> 0-based positions of ref / qty / date.

Every resolver is a fixed expression over the header array (no UDF):
alias lists are configuration and expand to ``coalesce`` chains in alias
priority order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_label, strip_text
from ledgerlens.operators.headers import normalize_label_py


def _h(header) -> Column:
    return F.col(header) if isinstance(header, str) else header


def _first_pos(arr: Column, value: str) -> Column:
    p = F.array_position(arr, F.lit(value))
    return F.when(p > 0, (p - 1).cast("int"))


def _last_pos(arr: Column, value: str) -> Column:
    p = F.array_position(F.reverse(arr), F.lit(value))
    return F.when(p > 0, (F.size(arr) - p).cast("int"))


def _first_present(arr: Column, names: Sequence[str]) -> Column:
    """The first of ``names`` (priority order) that occurs in ``arr``."""
    lits = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return F.try_element_at(F.filter(lits, lambda a: F.array_contains(arr, a)), F.lit(1))


def resolve_exact(header, aliases: Sequence[str]) -> Column:
    """First alias (priority order) present verbatim; its first column."""
    h = _h(header)
    hit = _first_present(h, list(aliases))
    p = F.array_position(h, hit)
    return F.when(hit.isNotNull() & (p > 0), (p - 1).cast("int"))


def resolve_casefold(header, aliases: Sequence[str], collapse: bool = False) -> Column:
    """Trimmed, case-folded match (``collapse``: whitespace runs too).

    When several columns normalise to the same label the last one is used,
    as a name -> column map built left to right keeps the last.
    """
    if collapse:
        norm = F.transform(_h(header), lambda x: normalize_label(x))
        keys = [normalize_label_py(a) for a in aliases]
    else:
        norm = F.transform(_h(header), lambda x: F.lower(strip_text(x)))
        keys = [str(a).strip().lower() for a in aliases]
    hit = _first_present(norm, keys)
    p = F.array_position(F.reverse(norm), hit)
    return F.when(hit.isNotNull() & (p > 0), (F.size(norm) - p).cast("int"))


def resolve_exact_then_casefold(header, aliases: Sequence[str]) -> Column:
    return F.coalesce(resolve_exact(header, aliases), resolve_casefold(header, aliases))


def resolve_contains(header, aliases: Sequence[str], upper: bool = True, strip: bool = True) -> Column:
    """First column (left to right) whose name contains one of the aliases."""
    def norm(x: Column) -> Column:
        x = strip_text(x) if strip else x
        return F.upper(x) if upper else x
    al = [a.upper() if upper else a for a in aliases]
    flags = F.transform(_h(header), lambda x: F.coalesce(
        F.exists(F.array(*[F.lit(a) for a in al]), lambda a: norm(x).contains(a)), F.lit(False)))
    p = F.array_position(flags, F.lit(True))
    return F.when(p > 0, (p - 1).cast("int"))


def resolve_custom_col(header, name: Column) -> Column:
    """First column where the configured name (a column) and the column name
    contain one another (upper-cased, stripped)."""
    c = F.upper(name)
    flags = F.transform(_h(header), lambda x: F.coalesce(
        c.contains(F.upper(strip_text(x))) | F.upper(strip_text(x)).contains(c), F.lit(False)))
    p = F.array_position(flags, F.lit(True))
    return F.when(p > 0, (p - 1).cast("int"))


def resolve_date_fallback(header, aliases: Sequence[str]) -> Column:
    """Exact alias, else the first column whose name contains 'date'."""
    flags = F.transform(_h(header), lambda x: F.coalesce(F.lower(x.cast("string")).contains("date"), F.lit(False)))
    p = F.array_position(flags, F.lit(True))
    return F.coalesce(resolve_exact(header, aliases), F.when(p > 0, (p - 1).cast("int")))


def override(header, name: Column, resolved: Column) -> Column:
    """A configured column name wins when it is present in the header; blank
    names and the '-1' sentinel mean no override."""
    n = F.when((strip_text(name) != "") & (name != "-1"), name)
    p = F.array_position(_h(header), n)
    return F.coalesce(F.when(p > 0, (p - 1).cast("int")), resolved)


def cell(pos: Column, cells: str = "cells") -> Column:
    """Cell at a 0-based position (NULL when missing)."""
    return F.when(pos.isNotNull(), F.try_element_at(F.col(cells), pos + 1))
