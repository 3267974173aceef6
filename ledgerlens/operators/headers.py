"""Header-row detection over sheet grids.

A grid is ``(file_id, sheet, row_idx, cells ARRAY<STRING>)`` with NULL for
empty cells.  Every rule is a per-sheet aggregate (``min`` of the qualifying
row index, searched in rounds from the top of the sheets, or the first row of
every count of cells for the densest row): partial aggregation runs map-side,
so no sheet is gathered into one task.  The result has one row per
sheet: ``(keys..., header_idx, found)``; without a qualifying row the first
row of the sheet is the header, as a headerless read would take it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_label, strip_text
from ledgerlens.session import checked_broadcast

KEYS = ("file_id", "sheet")

# Header keywords of the multi-sheet snapshot rule (the second
# entry is spelled as the rule spells it) and the substring that marks a date.
SNAPSHOT_HEADER_KEYWORDS = ["REFERENCE", "DESIGNIATION", "DATE", "QUANTITE", "REF"]
DATE_MARK = "date"


def present_values(cells: Column | str = "cells") -> Column:
    """Stripped text of the non-empty cells of a row."""
    c = F.col(cells) if isinstance(cells, str) else cells
    return F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: strip_text(x))


def _lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _scan(grid: DataFrame, max_rows: int | None) -> DataFrame:
    return grid.where(F.col("row_idx") < max_rows) if max_rows is not None else grid


#: Rows of the first stretch of a header search, and how much longer the
#: next one is.
STRETCH, LONGER = 128, 64


def _rule(grid: DataFrame, max_rows: int | None, keys: Sequence[str], *preds: Column) -> DataFrame:
    """First row satisfying the predicates in priority order, else the sheet's
    first row, with its cells.  ``max_rows``: only the first rows count, where
    a caller asks for such a limit (none does by default)."""
    return _picked(_hits(_scan(grid, max_rows), keys, preds), keys, len(preds)) if max_rows is not None else _search(grid, keys, preds)


def _search(grid: DataFrame, keys: Sequence[str], preds: Sequence[Column]) -> DataFrame:
    """The rule over whole sheets, in three rounds at most that stop early and
    stay exact: the first ``STRETCH`` rows, ``LONGER`` times as many, and all
    others, of only those sheets that have no row of the first predicate yet
    and are not at their end.  Every row is tested once at most; a grid written
    in row order is read up to the headers and no further.  A round keeps row
    numbers alone (a hash aggregate); the cells are fetched at the end, of the
    one row a sheet that is its header.  What is known per sheet is one row,
    joined by its checked size."""
    idx = F.col("row_idx")
    spans = checked_broadcast(grid.groupBy(*keys).agg(F.max(idx).alias("_end")), "sheet-spans")
    n = len(preds)
    parts = [F.min(F.when(p, idx)).alias(f"_h{i}") for i, p in [*enumerate(preds), ("f", F.lit(True))]]
    pending, found, at = spans, None, None
    for end in (STRETCH, STRETCH * (1 + LONGER), None):
        stretch = grid.where(idx < end) if end is not None else grid
        if found is not None:
            stretch = stretch.where(idx >= at).join(pending.select(*keys), list(keys), "left_semi")
        hits = checked_broadcast(stretch.groupBy(*keys).agg(*parts), "header-hits")
        found, at = hits if found is None else found.union(hits), end
        if end is None:
            break
        pending = pending.where(F.col("_end") >= at).join(hits.where("_h0 is not null").select(*keys), list(keys), "left_anti")
        if pending.isEmpty():
            break
    first = found.groupBy(*keys).agg(*[F.min(f"_h{i}").alias(f"_h{i}") for i in [*range(n), "f"]])
    picked = checked_broadcast(first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                            F.coalesce(*[f"_h{i}" for i in [*range(n), "f"]]).alias("_at")), "header-rows")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = _up_to(grid, picked, "_at").join(picked, [*same, idx == F.col("_at")], "left_semi")
    return _picked(_hits(rows, keys, preds), keys, n)


def _up_to(grid: DataFrame, picked: DataFrame, at: str) -> DataFrame:
    """The rows up to the last picked one, a bound that the scan knows."""
    return grid.where(F.col("row_idx") <= F.lit(picked.agg(F.max(at)).first()[0]))


def _hits(grid: DataFrame, keys: Sequence[str], preds: Sequence[Column]) -> DataFrame:
    """Per sheet: first row and its cells of every predicate, and of all rows."""
    idx, cells = F.col("row_idx"), F.col("cells")
    aggs = []
    for i, p in [*enumerate(preds), ("f", F.lit(True))]:
        aggs += [F.min(F.when(p, idx)).alias(f"_h{i}"), F.min_by(cells, F.when(p, idx)).alias(f"_c{i}")]
    return grid.groupBy(*keys).agg(*aggs)


def _picked(hits: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    hit = F.coalesce(*[F.col(f"_h{i}") for i in range(n)])
    cells = F.coalesce(*[F.when(F.col(f"_h{i}").isNotNull(), F.col(f"_c{i}")) for i in range(n)], F.col("_cf"))
    return hits.select(*keys, F.coalesce(hit, F.col("_hf")).alias("header_idx"), hit.isNotNull().alias("found"), cells.alias("header"))


def _fetch_cells(grid: DataFrame, picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach each sheet's header-row cells: the grid streams through one
    join with the one-row-per-sheet pick (broadcast when its measured size
    allows).  The picked row index came from the grid, so an inner join
    keeps every sheet."""
    picked = checked_broadcast(picked)
    g = _up_to(grid, picked, "header_idx").select(*keys, F.col("row_idx").alias("header_idx"), F.col("cells").alias("header"))
    return g.join(picked, [*keys, "header_idx"]).select(*keys, "header_idx", "found", "header")


def header_by_alias(grid: DataFrame, aliases: Sequence[str], keys: Sequence[str] = KEYS,
                    max_rows: int | None = None, normalize: bool = False) -> DataFrame:
    """First row holding one of ``aliases`` as a whole (stripped) cell.

    ``normalize`` compares collapsed-whitespace lower-case labels instead.
    """
    if normalize:
        vals = F.transform(F.filter(F.col("cells"), lambda x: x.isNotNull()), lambda x: normalize_label(x))
        targets = sorted({normalize_label_py(a) for a in aliases})
    else:
        vals = present_values()
        targets = list(aliases)
    pred = F.exists(vals, lambda v: F.array_contains(_lit_array(targets), v))
    if not normalize:  # the row's text holds the name then: a cheap test that most rows fail
        text = F.array_join("cells", "\n")
        pred = reduce(Column.__or__, [text.contains(a) for a in targets], F.lit(False)) & pred
    return _rule(grid, max_rows, keys, pred)


def header_by_names(grid: DataFrame, names_col: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``header_by_alias`` with the names taken from a column of the rows."""
    return _rule(grid, None, keys, F.coalesce(F.arrays_overlap(present_values(), F.col(names_col)), F.lit(False)))


def normalize_label_py(value: str) -> str:
    """Python twin of ``functions.text.normalize_label`` for config values."""
    return " ".join(str(value).split()).strip().lower()


def header_densest(grid: DataFrame, keys: Sequence[str] = KEYS, max_rows: int | None = None) -> DataFrame:
    """Row with the most non-empty cells; the first such row wins ties.

    The whole-sheet scan is a hash aggregate: the first row of every count of
    cells, of which the largest count's is taken; its cells are fetched by one
    join."""
    filled = F.size(F.filter(F.col("cells"), lambda x: x.isNotNull()))
    # False: neither an empty text nor a NULL among them, so all count
    n = F.when(~F.array_contains("cells", ""), F.size("cells")).otherwise(filled)
    firsts = _scan(grid, max_rows).where(F.col("row_idx").isNotNull()).groupBy(*keys, n.alias("_n")).agg(F.min("row_idx").alias("_i"))
    picked = firsts.groupBy(*keys).agg(F.max_by("_i", "_n").alias("header_idx")).select(*keys, "header_idx", F.lit(True).alias("found"))
    return _fetch_cells(grid, picked, keys)


def else_densest(headers: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``headers``, with the densest row where the rule found none."""
    d = header_densest(grid, keys).select(*keys, F.col("header_idx").alias("_i"), F.col("header").alias("_h"))
    pick = lambda a, b: F.when(F.col("found"), F.col(a)).otherwise(F.col(b)).alias(a)
    return headers.join(d, list(keys)).select(*keys, pick("header_idx", "_i"), "found", pick("header", "_h"))


def header_required(grid: DataFrame, required: Sequence[str], keys: Sequence[str] = KEYS,
                    max_rows: int | None = None, min_hits: int = 2) -> DataFrame:
    """First row with >= ``min_hits`` required names, or a cell containing 'date'."""
    vals = present_values()
    hits = F.size(F.array_intersect(vals, _lit_array(list(dict.fromkeys(required)))))
    has_date = F.exists(vals, lambda v: F.lower(v).contains(DATE_MARK))
    return _rule(grid, max_rows, keys, (hits >= min_hits) | has_date)


def header_required_col(grid: DataFrame, required_col: str, keys: Sequence[str] = KEYS,
                        max_rows: int | None = None, min_hits: int = 2) -> DataFrame:
    """``header_required`` with the required names taken from a column of the
    rows (per job configuration); NULL lists only test for 'date'."""
    vals = present_values()
    req = F.coalesce(F.col(required_col), F.array().cast("array<string>"))
    hits = F.size(F.array_intersect(vals, F.array_distinct(req)))
    has_date = F.exists(vals, lambda v: F.lower(v).contains(DATE_MARK))
    return _rule(grid, max_rows, keys, (hits >= min_hits) | has_date)


def header_tiered(grid: DataFrame, date_aliases: Sequence[str], ref_aliases: Sequence[str],
                  qty_aliases: Sequence[str], keys: Sequence[str] = KEYS, max_rows: int | None = None) -> DataFrame:
    """'date' substring or date alias first; else the first ref / qty alias row."""
    vals = present_values()
    tier12 = (F.exists(vals, lambda v: F.lower(v).contains(DATE_MARK))
              | F.arrays_overlap(vals, _lit_array(date_aliases)))
    tier3 = (F.arrays_overlap(vals, _lit_array(ref_aliases)) | F.arrays_overlap(vals, _lit_array(qty_aliases)))
    return _rule(grid, max_rows, keys, F.coalesce(tier12, F.lit(False)), F.coalesce(tier3, F.lit(False)))


def header_keywords(grid: DataFrame, keywords: Sequence[str] = SNAPSHOT_HEADER_KEYWORDS,
                    keys: Sequence[str] = KEYS, max_rows: int | None = None, min_hits: int = 2) -> DataFrame:
    """First row where >= ``min_hits`` keywords occur inside upper-cased cells."""
    vals = F.transform(present_values(), lambda v: F.upper(v))
    hits = sum(F.exists(vals, _contains(k)).cast("int") for k in keywords)
    return _rule(grid, max_rows, keys, hits >= min_hits)


def _contains(keyword: str):
    return lambda v: v.contains(keyword)


def header_cells(grid: DataFrame, headers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The header row's cells per sheet: ``(keys..., header_idx, found, header)``.

    Header rules already return the cells; only a bare ``header_idx`` table
    is joined back to the grid."""
    if "header" in headers.columns:
        return headers.select(*keys, "header_idx", "found", "header")
    h = headers.select(*keys, "header_idx", "found")
    g = grid.select(*keys, F.col("row_idx").alias("header_idx"), F.col("cells").alias("header"))
    return h.join(g, [*keys, "header_idx"], "left")
