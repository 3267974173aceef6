"""``process`` on files as they come: date cells, equal names, damaged and
old workbooks, missing sheets and columns, unknown ateliers."""

import io
import os
import re
import tempfile
import zipfile

import pytest

from ledgerlens.operators.sinks import workbook_bytes
from ledgerlens.plans.run import process

STYLES = ('<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1">'
          '<numFmt numFmtId="170" formatCode="dd/mm/yyyy\\ &quot;le&quot;"/></numFmts><cellStyleXfs><xf numFmtId="0"/></cellStyleXfs>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')


def dated(sheets, style=1, column="A"):
    """A workbook whose numeric cells of one column carry a date format."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook_bytes(sheets))) as src, zipfile.ZipFile(out, "w") as z:
        for n in src.namelist():
            data = src.read(n).decode()
            if n.startswith("xl/worksheets/"):
                data = re.sub(rf'(<c r="{column}\d+")>', rf'\1 s="{style}">', data)
            z.writestr(n, data)
        z.writestr("xl/styles.xml", STYLES)
    return out.getvalue()


def put(d, name, data):
    path = os.path.join(d, name)
    with open(path, "wb") as fh:
        fh.write(data if isinstance(data, bytes) else workbook_bytes(data))
    return path


def run(spark, files, **more):
    inputs = spark.createDataFrame(files, "unit string, role string, path string")
    recon, diag, _ = process(spark, inputs, 2025, 3, **more)
    got = {(r.unit, r.atelier, r.Ref): (r.Stock_Qty, r.Calc_Mov_Qty, r.status) for r in recon.collect()}
    return got, {(r.unit, r.code) for r in diag.collect()}


@pytest.mark.parametrize("style", [1, 2])
def test_date_cells_and_number_text(spark, style):
    d = tempfile.mkdtemp(dir="/tmp")
    stock = put(d, "STOCK 3-2025.xlsx", [("MOUV", [["Date", "REF", "QUANTITE", "LOCALISATION"], [None, "1.1", "10", "AT- TUFTING"], [None, "7", "2", "AT- TUFTING"]])])
    mov = put(d, "MOV x.xlsx", dated([("Feuil1", [["Date", "REF", "STOCK"], [45717, 1.1000000000000001, 10], [45717.5, 7.0, 2], [45748, 7, 50]])], style))
    from ledgerlens.plans.pipeline import UnitRules, run_units
    from ledgerlens.plans.sites import JOB_DDL
    from ledgerlens.sources.xlsx import read_xlsx_grid
    from pyspark.sql import functions as F
    grid = read_xlsx_grid(spark, mov)
    assert [r.cells[0] for r in grid.orderBy("row_idx").collect()][1:] == ["2025-03-01", "2025-03-01 12:00:00", "2025-04-01"]
    assert [r.cells[1] for r in grid.orderBy("row_idx").collect()][1:] == ["1.1", "7", "7"]
    job = [("Mdoukal", "x", 0, "x", ["Feuil1"], False, None, None, ["AT- TUFTING"], None, None, None, None, None, False, mov)]
    recon, diag = run_units(read_xlsx_grid(spark, stock).withColumn("unit", F.lit("Mdoukal")), grid,
                            spark.createDataFrame(job, JOB_DDL + ", file_id string"), [UnitRules.from_profile("Mdoukal")], 2025, 3)
    assert {r.Ref: (r.Stock_Qty, r.Calc_Mov_Qty, r.status) for r in recon.collect()} == {"1,1": (10.0, 10.0, "match"), "7": (2.0, 2.0, "match")}
    assert diag.count() == 0


def test_equal_names_in_two_units(spark):
    one, two = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    files = []
    for unit, d, qty, place, sheet in (("Fath1", one, 10, "MAGASINE DE BLOCS", "MOUVEM 09"), ("Fath2", two, 99, "ATT SFIFA", "MOUVEMENT 2024")):
        stock = [["Date", "REFERENCE", "DESIGNATION", "QUANTITE", "LOCALISATION"], ["1/1/2024", "B1", "d", qty, place]]
        files.append((unit, "stock", put(d, "STOCK 3-2025.xlsx", [("STOCK", stock)])))
        files.append((unit, "ledger", put(d, "MOV bloc sfifa.xlsx", [(sheet, [["Date", "REFERENCE", "STOCK"], ["1/1/2024", "B1", qty]])])))
    got, _ = run(spark, files)
    assert got == {("Fath1", "bloc", "B1"): (10.0, 10.0, "match"), ("Fath2", "sfifa", "B1"): (99.0, 99.0, "match")}


def test_damaged_old_and_incomplete_files_become_diagnostics(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    files = [("Fath1", "stock", put(d, "STOCK 3-2025.xlsx", [("STOCK", [["REFERENCE", "DESIGNATION", "QUANTITE", "LOCALISATION"], ["B1", "d", 4, "MAGASINE DE BLOCS"]])])),
             ("Fath1", "ledger", put(d, "MOV bloc.xlsx", [("MOUVEM 09", [["Date", "REFERENCE", "STOCK"], ["1/1/2024", "B1", 4], ["x", None, "q"]])])),
             ("Fath1", "ledger", put(d, "MOV rouler.xlsx", [("no such sheet", [["Date", "REFERENCE", "STOCK"], ["1/1/2024", "Z", 1]])])),
             ("Fath1", "ledger", put(d, "mov-com.xlsx", b"this is no workbook")),
             ("Fath1", "ledger", put(d, "MOV old.xls", b"\xd0\xcf\x11\xe0")),
             ("Oran", "ledger", put(d, "MOV block.xlsx", [("Movement Block", [["Date", "REFERENCE", "Q"], ["1/3/2025", "B1", 4]])]))]
    odd = spark.createDataFrame([("Fath1", "no such atelier")], "unit string, atelier string")
    got, codes = run(spark, files, skip=odd)
    assert got[("Fath1", "bloc", "B1")] == (4.0, 4.0, "match")
    assert {k for k in got if k[0] == "Fath1"} == {("Fath1", "bloc", "B1")}
    for want in (("Fath1", "MISSING_SHEET"), ("Fath1", "UNREADABLE_FILE"), ("Fath1", "BLANK_REF"), ("Fath1", "BAD_QUANTITY"), ("Fath1", "BAD_DATE"),
                 ("Fath1", "UNKNOWN_ATELIER"), ("Oran", "MISSING_INPUT"), ("Fath1", "UNMATCHED_FILE")):
        assert want in codes, want


def test_oran_name_parts_and_ledger_without_a_date_header(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    files = [("Oran", "stock", put(d, "STOCK 3-2025.xlsx", [("Stock Block", [["Etat"], ["REFERENCE PRODUIT", "x", "QUANTITE"], ["B1", "x", 4]])])),
             ("Oran", "ledger", put(d, "MOV block.xlsx", [("Movement Block", [["Suivi"], ["Jour", "REFERENCE", "Q"], ["1/3/2025", "B1", 4]])]))]
    got, codes = run(spark, files)
    assert got == {("Oran", "block", "B1"): (4.0, 4.0, "match")}
    assert not any(c.startswith("MISSING") for _, c in codes)


def test_fath3_needs_date_and_location(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    files = [("Fath3", "stock", put(d, "STOCK 3-2025.xlsx", [("STOCKS", [["RF", "S REEL", "LOCALISATION"], ["P1", 5, "ATT PET"]])])),
             ("Fath3", "ledger", put(d, "MOV pet.xlsx", [("MOUV PARC03-2023", [["Date", "PRODOUITE", "Q ST PV"], ["1/3/2025", "P1", 5]])]))]
    got, codes = run(spark, files)
    assert got == {} and ("Fath3", "MISSING_COLUMN") in codes


def test_snapshot_without_its_columns(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    files = [("Fath1", "stock", put(d, "STOCK 3-2025.xlsx", [("STOCK", [["ARTICLE", "NOMBRE"], ["B1", 4]])])),
             ("Fath1", "ledger", put(d, "MOV bloc.xlsx", [("MOUVEM 09", [["Date", "REFERENCE", "STOCK"], ["1/1/2024", "B1", 4]])]))]
    got, codes = run(spark, files)
    assert got == {} and ("Fath1", "MISSING_COLUMN") in codes


def test_header_far_down_the_sheet(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    far = [[f"note {i}"] for i in range(120)]
    files = [("Mags", "stock", put(d, "STOCK 3-2025.xlsx", [("MAG", far + [["REFERENCE", "QUANTITE"], ["M1", 3]])])),
             ("Mags", "ledger", put(d, "MOV magz.xlsx", [("MOUV", far + [["Date", "REFERENCE", "QUANTITE"], ["3/5/2025", "M1", 3]])]))]
    got, _ = run(spark, files)
    assert got == {("Mags", "magz", "M1"): (3.0, 3.0, "match")}
