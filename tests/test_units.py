"""All-units pipeline on hand-written workbooks, using the real site
configuration (plans.sites) and unit rules (plans.profiles)."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.operators.sinks import workbook_bytes
from ledgerlens.plans.pipeline import UnitRules, run_units
from ledgerlens.plans.sites import JOB_DDL, job_rows
from ledgerlens.sources.xlsx import read_xlsx_grid


def write(d, name, sheets):
    with open(os.path.join(d, name), "wb") as fh:
        fh.write(workbook_bytes(sheets))


def jobs_for(spark, unit, files, d):
    rows = [r + (os.path.join(d, files[r[1]]),) for r in job_rows(unit) if r[1] in files]
    return spark.createDataFrame(rows, JOB_DDL + ", file_id string")


def grid(spark, d, unit):
    return read_xlsx_grid(spark, os.path.join(d, "*.xlsx")).withColumn("unit", F.lit(unit))


def results(recon):
    return {(r.atelier, r.job_idx, r.Ref): (r.Stock_Qty, r.Calc_Mov_Qty, r.status) for r in recon.collect()}


def test_fath3_implicit_locations_serial_dates_locale(spark):
    sd, md = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    write(sd, "STOCK F3.xlsx", [("STOCKS", [["ETAT STOCK"], ["RF", "DESIGNATION", "S REEL", "LOCALISATION"],
                                            ["P1", "x", "1 234,50", "ATT PET"], ["P2", "x", "10", "ATT PET"],
                                            ["P2", "x", "5", "ATT TRIAGE"], ["P3", "x", "abc", "ATT PET"]])])
    write(md, "MOV pet.xlsx", [("MOUV PARC03-2023", [
        ["Date", "LOCALITATION", "PRODOUITE", "Q ST PV"],
        [45717, "ATT PET", "P1", "1234,5"],           # 2025-03-01
        [45658, "ATT PET", "P2", "9.90"],             # 2025-01-01
        [45748, "ATT PET", "P2", "100"],              # 2025-04-01: after the cutoff
        [45720, "ATT TRIAGE", "P2", "5"],             # excluded location
        [45720, None, "P3", "1"]])])                  # no location: dropped
    write(md, "MOV triage.xlsx", [("MOUVM", [["DATE", "PRODUIT", "STOCK"], ["15/03/2025", "P2", "5"],
                                             ["16/03/2025", "P9", "1"]])])
    jobs = jobs_for(spark, "Fath3", {"pet": "MOV pet.xlsx", "triage": "MOV triage.xlsx"}, md)
    recon, diag = run_units(grid(spark, sd, "Fath3"), read_xlsx_grid(spark, md + "/*.xlsx"), jobs,
                            [UnitRules.from_profile("Fath3")], 2025, 3)
    got = results(recon)
    assert got == {("pet", 0, "P1"): (1234.5, 1234.5, "match"),
                   ("pet", 0, "P2"): (10.0, 9.9, "discrepancy"),
                   ("pet", 0, "P3"): (0.0, 0.0, "match"),
                   ("triage", 0, "P2"): (5.0, 5.0, "match"),
                   ("triage", 0, "P9"): (0.0, 1.0, "discrepancy")}
    assert [(r.scope.split("/")[-1], r.code) for r in diag.collect()] == [("STOCKS", "BAD_QUANTITY")]


def test_fibre_pairs_plain_locations_and_two_jobs(spark):
    sd, md = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    write(sd, "STOCK fibre.xlsx", [("STOCKS GLOBALE", [["LOCAL", "LOCALISATION", "PRODUIT", "S REEL"],
                                                      ["At-Fibre2", "DRAFTER", "F1", "3"],
                                                      ["At-Fibre2", "EXTREDEUSE", "F1", "7"],
                                                      ["MAGASIN", "X", "F2", "4.004"],
                                                      ["MAGASIN-LAROBI", "Y", "F2", "6"]])])
    write(md, "MOV drafter.xlsx", [("Drafter", [["Date", "REFERENCE", "STOCK"], ["3/2/2025", "F1", "3"],
                                                ["4/15/2025", "F1", "1"]])])
    write(md, "MOV magaisain fibre.xlsx", [
        ("MOUVEMENT", [["Date", "REF PRODUIT", "Quantité"], ["1/10/2025", "F2", "4"]]),
        ("UNITE ETPH", [["Date", "REF PRODUIT", "S REEL"], ["2/1/2025", "F2", "5"]])])
    jobs = jobs_for(spark, "Fibre", {"drafter": "MOV drafter.xlsx", "magaisain fibre": "MOV magaisain fibre.xlsx"}, md)
    recon, _ = run_units(grid(spark, sd, "Fibre"), read_xlsx_grid(spark, md + "/*.xlsx"), jobs,
                         [UnitRules.from_profile("Fibre")], 2025, 3)
    assert results(recon) == {("drafter", 0, "F1"): (3.0, 3.0, "match"),
                              ("magaisain fibre", 0, "F2"): (4.0, 4.0, "match"),
                              ("magaisain fibre", 1, "F2"): (6.0, 5.0, "discrepancy")}


def test_larbaa_stacked_pairs_and_custom_quantity_columns(spark):
    sd, md = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    write(sd, "STOCK larbaa.xlsx", [
        ("ATT MATELAS ROULEE 01", [["Inventaire"], ["REFERENCE", "DESIGNATION", "QUANTITE"],
                                   ["R1", "x", "10"], ["R2", "x", "3"]]),
        ("ATT-PROD OUATE", [["REF", "QUANTITE/KG"], ["O1", "1.5"]]),
        ("ATT-FIBRE CARDEE", [["REF", "QUANTITE KG"], ["O1", "2"]]),
        ("ATT-OUATINAGE", [["REF", "DESIGNATION", "QUANTITE/M"], ["O2", "y", "3"]])])
    write(md, "MOV roules.xlsx", [
        ("Sortie Atelier 01", [["Suivi"], ["LA DATE", "REF", "STOCK"], ["13/02/2025", "R1", "6"],
                               ["14/02/2025", "R2", "1"]]),
        ("Matière consommable", [["Date", "Ref", "Stock"], ["03/01/2025", "R1", "4"], ["03/25/2025", "R2", "1"]])])
    write(md, "MOV ouate.xlsx", [
        ("Opérations Ouate", [["Date", "REF", "STOCK"], ["1/1/2025", "O1", "1.5"]]),
        ("Opération Cardinage", [["Date", "REF", "STOCK"], ["2/1/2025", "O1", "2"]]),
        ("Opérations Ouatinage", [["Date", "REF", "STOCK"], ["2/1/2025", "O2", "2"]])])
    jobs = jobs_for(spark, "Larbaa", {"roulés.sortie": "MOV roules.xlsx", "(ouate": "MOV ouate.xlsx"}, md)
    recon, _ = run_units(grid(spark, sd, "Larbaa"), read_xlsx_grid(spark, md + "/*.xlsx"), jobs,
                         [UnitRules.from_profile("Larbaa")], 2025, 3)
    assert results(recon) == {("roulés.sortie", 0, "R1"): (10.0, 10.0, "match"),
                              ("roulés.sortie", 0, "R2"): (3.0, 2.0, "discrepancy"),
                              ("(ouate", 0, "O1"): (1.5, 1.5, "match"),
                              ("(ouate", 1, "O1"): (2.0, 2.0, "match"),
                              ("(ouate", 2, "O2"): (3.0, 2.0, "discrepancy")}


def test_mags_rollforward_with_opening_snapshot(spark):
    sd, od, md = (tempfile.mkdtemp(dir="/tmp") for _ in range(3))
    write(sd, "STOCK 3-2025.xlsx", [("MAG", [["Inventaire"], ["REFERENCE", "QUANTITE"], ["M1", "10"], ["M2", "5"]])])
    write(od, "STOCK 2-2025.xlsx", [("Feuil1", [["REFERENCE", "QUANTITE"], ["M1", "7"], ["M3", "1"]])])
    write(md, "MOV magz.xlsx", [("MOUV", [["Date", "REFERENCE", "QUANTITE"], ["3/5/2025", "M1", "3"],
                                          ["2/28/2025", "M2", "100"], ["3/20/2025", "M2", "5.005"]])])
    jobs = jobs_for(spark, "Mags", {"magz": "MOV magz.xlsx"}, md)
    recon, _ = run_units(grid(spark, sd, "Mags"), read_xlsx_grid(spark, md + "/*.xlsx"), jobs,
                         [UnitRules.from_profile("Mags")], 2025, 3, opening_grid=grid(spark, od, "Mags"))
    assert results(recon) == {("magz", 0, "M1"): (10.0, 10.0, "match"),
                              ("magz", 0, "M2"): (5.0, 5.01, "match"),
                              ("magz", 0, "M3"): (0.0, 1.0, "discrepancy")}


def test_oran_listed_sheet_collapsed_labels(spark):
    sd, md = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    write(sd, "STOCK oran.xlsx", [("Stock Block", [["Etat"], ["Référence", "Désignation", "Q-REEL", "U"],
                                                   ["B1", "x", "4", "9"], ["B2", "x", "1", "9"]])])
    write(md, "MOV block.xlsx", [("Movement Block", [["Suivi"], ["  DATE ", "REFERENCE", "Q"],
                                                     ["1/3/2025", "B1", "4"]])])
    jobs = jobs_for(spark, "Oran", {"block": "MOV block.xlsx"}, md)
    recon, _ = run_units(grid(spark, sd, "Oran"), read_xlsx_grid(spark, md + "/*.xlsx"), jobs,
                         [UnitRules.from_profile("Oran")], 2025, 3)
    assert results(recon) == {("block", 0, "B1"): (4.0, 4.0, "match"),
                              ("block", 0, "B2"): (1.0, 0.0, "discrepancy")}


def test_two_units_in_one_plan_with_column_override(spark):
    s2, s5, md = (tempfile.mkdtemp(dir="/tmp") for _ in range(3))
    write(s2, "STOCK f2.xlsx", [("Feuil1", [["x"]]),
                                ("MOV STOCK", [["titre"], ["Date", "REFERENCE", "QUANTITE", "LOCALISATION"],
                                               ["1/1/2025", "A1", "2", "ATT OUATE 01"],
                                               ["1/1/2025", "A2", None, "ATT OUATE 01"],
                                               ["1/1/2025", "A9", "7", "ELSEWHERE"]])])
    write(s5, "STOCK f5.xlsx", [("MOUVEMENT STOCK", [["Date", "REF ARTICLE", "QUANTITE", "LOCALISATION"],
                                                     ["1/1/2025", "S1", "5", "MAGASIN SECONDAIRE EL FATEH 05"]])])
    write(md, "MOV ouate 01.xlsx", [("الحركة اليومية", [["Date", "REFERENCE", "STOCK"], ["3/1/2025", "A1", "2"],
                                                         ["3/2/2025", "A2", "1"]])])
    write(md, "MOV secondaire.xlsx", [("MAG", [["Date", "REFERENCE", "STOCK", "Q-STOCKS"], ["3/1/2025", "S1", "99", "5"]])])
    jobs = jobs_for(spark, "Fath2", {"ouate 01": "MOV ouate 01.xlsx"}, md).unionByName(
        jobs_for(spark, "Fath5", {"secondaire": "MOV secondaire.xlsx"}, md))
    stock = grid(spark, s2, "Fath2").unionByName(grid(spark, s5, "Fath5"))
    recon, diag = run_units(stock, read_xlsx_grid(spark, md + "/*.xlsx"), jobs,
                            [UnitRules.from_profile("Fath2"), UnitRules.from_profile("Fath5")], 2025, 3)
    got = {(r.unit, r.atelier, r.Ref): (r.Stock_Qty, r.Calc_Mov_Qty, r.status) for r in recon.collect()}
    assert got == {("Fath2", "ouate 01", "A1"): (2.0, 2.0, "match"),
                   ("Fath2", "ouate 01", "A2"): (0.0, 1.0, "discrepancy"),
                   ("Fath5", "secondaire", "S1"): (5.0, 5.0, "match")}
    assert diag.count() == 0


def test_process_from_files_with_matching_skip_and_override(spark):
    from ledgerlens.plans.run import process
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "STOCK 3-2025.xlsx", [("Feuil1", [["x"]]), ("STOCK", [
        ["ETAT"], ["REFERENCE", "DESIGNATION", "QUANTITE", "LOCALISATION"],
        ["B1", "d", "4", "MAGASINE DE BLOCS"], ["B1", "d", "1", "MAGASIN COMMERCIAL"],
        ["C1", "d", "2", "MAGASIN COMMERCIAL"], ["Z", "d", "9", "ATT  ROULER"]])])
    write(d, "MOV bloc 2025.xlsx", [("MOUVEM 09", [["Titre"], ["Date", "REFERENCE", "STOCK"],
                                                   ["1/1/2024", "B1", "4"], ["2/1/2024", "B2", "1"]])])
    write(d, "mov-com.xlsx", [("MOV", [["Date", "REFERENCE", "STOCK", "QTE"], ["1/1/2025", "C1", "99", "2"],
                                       ["1/1/2025", "B1", "0", "1.5"]])])
    write(d, "MOV rouler.xlsx", [("MOVEMENT ROLI", [["Date", "REFERENCE", "STOCK"], ["1/1/2025", "Z", "9"]])])
    write(d, "notes.xlsx", [("S", [["x"]])])
    paths = [("Fath1", "stock", f"{d}/STOCK 3-2025.xlsx")] + [
        ("Fath1", "ledger", f"{d}/{n}") for n in ("MOV bloc 2025.xlsx", "mov-com.xlsx", "MOV rouler.xlsx", "notes.xlsx")]
    inputs = spark.createDataFrame(paths, "unit string, role string, path string")
    skip = spark.createDataFrame([("Fath1", "rouler")], "unit string, atelier string")
    ovr = spark.createDataFrame([("Fath1", "mov-com", "", None, "QTE")],
                                "unit string, atelier string, sheet_name string, ref_col string, qty_col string")
    recon, diag, assigned = process(spark, inputs, 2025, 3, skip=skip, overrides=ovr)
    assert {(r.atelier, r.path.split("/")[-1]) for r in assigned.collect()} == {
        ("bloc", "MOV bloc 2025.xlsx"), ("mov-com", "mov-com.xlsx")}
    got = {(r.atelier, r.Ref): (r.Stock_Qty, r.Calc_Mov_Qty, r.status) for r in recon.collect()}
    assert got == {("bloc", "B1"): (4.0, 4.0, "match"), ("bloc", "B2"): (0.0, 1.0, "discrepancy"),
                   ("mov-com", "C1"): (2.0, 2.0, "match"), ("mov-com", "B1"): (1.0, 1.5, "discrepancy")}
    assert {(r.code, r.scope) for r in diag.collect()} == {("UNMATCHED_FILE", "MOV rouler.xlsx"),
                                                          ("UNMATCHED_FILE", "notes.xlsx")}


def test_cells_are_cleaned_once_a_row(spark):
    """No filter or join condition cleans a cell again: what they read is
    computed once, below them."""
    from ledgerlens.plans.pipeline import movement_lines, snapshot_lines

    ledger = [("m.xlsx", 0, "MOV", i, c) for i, c in enumerate(
        [["Date", "REF", "STOCK"], ["1/2/2025", " A.1 ", "2.005"], ["1/2/2025", "1.5", " 3 "], ["9/9/2025", "1.5", "7"],
         ["x", "1.5", "7"], ["1/2/2025", " ", "4"], ["1/2/2025", None, "4"], [None, None, None]])]
    stock = [("s.xlsx", 0, "MOUV", i, c) for i, c in enumerate(
        [["Date", "REF", "QUANTITE", "LOCALISATION"], [None, "A.1 ", "2.01", " L "], [None, "1.5", "x", "L"], [None, "1.5", "9", "other"]])]
    ddl = "file_id string, sheet_pos int, sheet string, row_idx bigint, cells array<string>"
    mov, st = spark.createDataFrame(ledger, ddl), spark.createDataFrame(stock, ddl).withColumn("unit", F.lit("Mdoukal"))
    job = ("Mdoukal", "a", 0, "a", ["MOV"], False, None, None, ["L"], None, None, None, None, None, False, "m.xlsx")
    jobs = spark.createDataFrame([job], JOB_DDL + ", file_id string")
    r = UnitRules.from_profile("Mdoukal")
    lines, _, _ = movement_lines(mov, jobs, r, 2025, 3)
    lines = lines.where(F.col("ref").isNotNull())
    assert sorted((x.ref, str(x.qty), str(x.mov_date)) for x in lines.collect()) == [
        ("1,5", "3.0000", "2025-01-02"), ("A.1", "2.0100", "2025-01-02")]
    snap, _, _ = snapshot_lines(st, jobs, r)
    snap = snap.where(F.col("ref").isNotNull() & (F.col("localisation") == "L"))
    assert sorted((x.ref, str(x.qty)) for x in snap.collect()) == [("1,5", "0.0000"), ("A.1", "2.0100")]
    recon, _ = run_units(st, mov, jobs, [r], 2025, 3)
    assert results(recon) == {("a", 0, "A.1"): (2.01, 2.01, "match"), ("a", 0, "1,5"): (0.0, 3.0, "discrepancy")}
    for df in (lines, snap, recon):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        assert not [x for x in plan if ("Join" in x or " Filter " in x) and "cells#" in x and ("regexp_replace(" in x or "trim(" in x)]
