"""Registered queries: file verification, diagnostics, CSV export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.numbers import coerce_number
from ledgerlens.functions.text import normalize_ref
from ledgerlens.operators import columns as C
from ledgerlens.operators import headers as H
from ledgerlens.operators import sinks
from ledgerlens.operators.loaders import extract, missing_columns
from ledgerlens.operators.sheets import restrict, sheet_by_keywords
from ledgerlens.operators.verify import blank_ref_diagnostics, missing_inputs, verification
from ledgerlens.plans import sql_grid as SG
from ledgerlens.plans.profiles import aliases, ledger_names
from ledgerlens.plans.registry import query
from ledgerlens.sources import grids as G


@query("verify_files", SG.VERIFY_FILES)
def verify_files(spark, sf_dir):
    """Every ledger file under the names and sheets of four units: sheet
    looked at, its columns, ref / qty / date columns found, list of errors."""
    g = G.ledger_grid(spark, sf_dir)
    sheets = {"Fath1": ["MOUVEMENT"], "Fath3": ["ABSENT", "MOV"], "Larbaa": ["0"], "Mags": []}
    units = spark.createDataFrame(list(sheets.items()), "unit string, expected_sheets array<string>")
    jobs = (G.sheets_of(g).select("file_id").distinct().withColumn("unit", F.explode(F.array(*[F.lit(u) for u in sheets])))
            .join(F.broadcast(units), "unit").select("unit", F.substring("file_id", 5, 1).alias("atelier"), "file_id", "expected_sheets"))
    return verification(g, jobs, ledger_names(spark, sheets))


@query("diagnostics", SG.DIAGNOSTICS)
def diagnostics(spark, sf_dir):
    """Errors as data - missing columns per sheet, blank refs, units
    lacking a snapshot or a ledger; other sheets and units still run."""
    g = G.ledger_grid(spark, sf_dir)
    g = restrict(g, sheet_by_keywords(G.sheets_of(g), ["MOUV", "MOV"]).select("file_id", "sheet"))
    hc = H.header_cells(g, H.header_by_alias(g, aliases("Fath1", "mov", "date")))
    roles = {"ref": C.resolve_exact("header", aliases("Fath1", "mov", "ref")),
             "qty": C.resolve_exact("header", aliases("Fath1", "mov", "quantity"))}
    miss = missing_columns(hc, roles, ["ref", "qty"]).select(
        F.concat_ws("/", "file_id", "sheet").alias("scope"), "severity", "code", "message")
    lines = extract(g, hc, roles)
    typed = lines.where(F.col("ref_pos").isNotNull() & F.col("qty_pos").isNotNull()).select(
        "file_id", normalize_ref("ref").alias("ref"), coerce_number("qty").alias("qty"))
    blanks = blank_ref_diagnostics(typed, ["file_id"])
    files = G.sheets_of(g).select("file_id").distinct().select(
        F.substring("file_id", 6, 1).alias("unit"), "file_id")
    units = spark.createDataFrame([("F",), ("O",), ("X",)], "unit string")
    ledgers = files.join(hc.where("found").select("file_id"), "file_id", "left_semi")
    snaps = files.where(F.col("unit") != "X")
    return miss.unionByName(blanks).unionByName(missing_inputs(units, snaps, ledgers))


def _export_sql() -> str:
    from ledgerlens.plans.q_results import _UNIT_RECON
    return (_UNIT_RECON + "SELECT Ref, CAST(Stock_Qty AS VARCHAR) AS Stock_Qty, "
            "CAST(Calc_Mov_Qty AS VARCHAR) AS Calc_Mov_Qty, CAST(Difference AS VARCHAR) AS Difference, "
            "unit, atelier, status FROM recon")


_EXPORT_SQL = _export_sql()


@query("export_csv", _EXPORT_SQL)
def export_csv(spark, sf_dir):
    """Results written as CSV per (unit, atelier, status), read back."""
    from ledgerlens.plans.q_results import unit_recon
    path = sinks.fresh_output(spark, "export-csv")
    sinks.write_csv(unit_recon(spark, sf_dir), path)
    return sinks.read_csv_results(spark, path)
