"""Result summaries and the discrepancy report (as ordered text lines).

The report is a table of lines ``(unit, atelier, line_no, line)`` rather than
one string per atelier: an atelier's discrepancies are never concatenated in
one task.  ``sinks.write_report`` writes the lines range-partitioned by
(unit, atelier, line_no), so a large atelier spans several ordered part files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import discrepancy_order_signed, rank_within
from ledgerlens.operators.reconcile import DISCREPANCY, MATCH

# Report table header, separator and month names.
REPORT_HEADER = "| REFERENCE | ETAT STOCKS | FICHIER DE MOV | ECARTS |"
REPORT_SEPARATOR = "|-----------|-------------|----------------|--------|"
MONTHS_EN = ["January", "February", "March", "April", "May", "June",
             "July", "August", "September", "October", "November", "December"]
MONTHS_AR = ["يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو",
             "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر"]


def summary(recon: DataFrame, keys: Sequence[str] = ("unit", "atelier")) -> DataFrame:
    """Match / discrepancy counts per atelier, per unit and overall (rollup)."""
    st = F.col("status")
    return (recon.rollup(*keys)
            .agg(F.sum(F.when(st == MATCH, 1).otherwise(0)).cast("long").alias("n_matches"),
                 F.sum(F.when(st == DISCREPANCY, 1).otherwise(0)).cast("long").alias("n_discrepancies")))


def report_select(recon: DataFrame, selection: DataFrame, keys: Sequence[str] = ("unit", "atelier")) -> DataFrame:
    """Discrepancies of the selected ateliers (selection is a small table)."""
    disc = recon.where(F.col("status") == DISCREPANCY)
    return disc.join(F.broadcast(selection.select(*keys).distinct()), list(keys), "left_semi")


def _fmt(c: str):
    return F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))


def report_lines(selected: DataFrame, keys: Sequence[str] = ("unit", "atelier")) -> DataFrame:
    """One row per Markdown line: heading, table header, rows, closing rule."""
    atelier = keys[-1]
    ranked = rank_within(selected, keys, discrepancy_order_signed())
    rows = ranked.select(*keys, (F.col("rank") + 2).alias("line_no"),
                         F.concat(F.lit("| "), F.col("Ref"), F.lit(" | "), _fmt("Stock_Qty"), F.lit(" | "),
                                  _fmt("Calc_Mov_Qty"), F.lit(" | "), _fmt("Difference"), F.lit(" |"))
                         .alias("line"))
    groups = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fixed = groups.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("## "), F.col(atelier)).alias("line")),
        F.struct(F.lit(1).cast("long").alias("line_no"), F.lit(REPORT_HEADER).alias("line")),
        F.struct(F.lit(2).cast("long").alias("line_no"), F.lit(REPORT_SEPARATOR).alias("line")),
        F.struct((F.col("_n") + 3).alias("line_no"), F.lit("---").alias("line")))).alias("x"))
    fixed = fixed.select(*keys, "x.line_no", "x.line")
    return rows.unionByName(fixed)


def report_heading(units: DataFrame, year: int, month: int, run_date: str,
                   title: str = "Stock control report", labels: DataFrame | None = None,
                   lang: str = "en", intro: str | None = None) -> DataFrame:
    """Heading lines per unit (negative line numbers sort before the tables).

    ``intro``: a sentence between two rules above the tables; ``{month}`` and
    ``{year}`` in it stand for the name of the month and the year.

    ``labels(unit, location)`` maps a unit to its site label; without a label
    the unit code is shown.  The run date is a parameter (no clock is read).
    """
    names = MONTHS_AR if lang == "ar" else MONTHS_EN
    u = units.select("unit").distinct()
    if labels is not None:
        u = u.join(F.broadcast(labels), "unit", "left")
    else:
        u = u.withColumn("location", F.lit(None).cast("string"))
    d = run_date.replace("-", "/")
    month_name = names[month - 1]
    lines = [F.lit(f"# {title}"), F.concat(F.coalesce("location", "unit"), F.lit(f"    **{d}**")), F.lit(f"{month_name} {year}"), F.lit("---")]
    if intro is not None:
        lines += [F.lit(intro.replace("{month}", month_name).replace("{year}", str(year))), F.lit("---")]
    return u.select("unit", F.lit(None).cast("string").alias("atelier"), F.explode(F.array(*[
        F.struct(F.lit(i - len(lines)).cast("long").alias("line_no"), x.alias("line")) for i, x in enumerate(lines)])).alias("x")
    ).select("unit", "atelier", "x.line_no", "x.line")
