"""File verification, order of results and the report's introduction."""

import os
import tempfile

from conftest import grid_df
from pyspark.sql import functions as F

from ledgerlens.operators import sinks
from ledgerlens.operators.ordering import positioned
from ledgerlens.operators.report import report_heading
from ledgerlens.operators.verify import verification

NAMES = "unit string, date array<string>, ref array<string>, quantity array<string>"


def test_verification_rules(spark):
    g = grid_df(spark, [["title", None], ["REF", "STOCK"], ["a", "1"]], "nodate.xlsx", "MOV")
    g = g.union(grid_df(spark, [["x"], ["Date", "B", "A", "QTE"]], "both.xlsx", "S1")).union(
        grid_df(spark, [["Date"]], "both.xlsx", "S2").withColumn("sheet_pos", F.lit(1)))
    names = spark.createDataFrame([("u", ["Date"], ["A", "B"], ["QTE"]), ("v", ["Day"], ["REF"], ["STOCK"])], NAMES)
    jobs = [("u", "1", "both.xlsx", ["NO", "S1"]), ("u", "2", "both.xlsx", ["0"]), ("u", "3", "both.xlsx", ["S2"]), ("u", "4", "both.xlsx", []),
            ("v", "5", "nodate.xlsx", ["MOV"]), ("v", "6", "gone.xlsx", ["MOV"])]
    jobs = spark.createDataFrame(jobs, "unit string, atelier string, file_id string, expected_sheets array<string>")
    broken = spark.createDataFrame([("gone.xlsx", "BadZipFile")], "file_id string, message string")
    got = {r.atelier: r for r in verification(g, jobs, names, broken).collect()}
    assert got["1"].valid and (got["1"].detected_ref, got["1"].detected_qty, got["1"].detected_date) == ("A", "QTE", "Date")
    assert got["2"].errors == ["Sheet '0' not found"] and got["2"].checked_sheet == "S1" and got["2"].detected_ref == "A"
    assert got["3"].errors == ["Reference column not found", "Quantity column not found"]
    assert got["4"].valid and got["4"].checked_sheet == "S1"
    # without a date name the first row is the header; a missing date column is no error
    assert got["5"].errors == ["Reference column not found", "Quantity column not found"] and got["5"].available_columns == ["title"]
    assert got["6"].errors == ["BadZipFile"] and not got["6"].valid


def test_a_missing_date_column_is_no_error(spark):
    g = grid_df(spark, [["REF", "STOCK"], ["a", "1"]], "n.xlsx", "MOV")
    names = spark.createDataFrame([("v", ["Day"], ["REF"], ["STOCK"])], NAMES)
    jobs = spark.createDataFrame([("v", "5", "n.xlsx", ["MOV"])], "unit string, atelier string, file_id string, expected_sheets array<string>")
    r = verification(g, jobs, names).first()
    assert r.valid and r.errors == [] and r.detected_date is None and r.detected_ref == "REF"


def test_verify_request_over_files(spark):
    from ledgerlens.plans.run import atelier_keywords, verify
    from ledgerlens.plans.sites import SITES
    d = tempfile.mkdtemp(prefix="ll-test-", dir="/tmp")
    atelier = next(iter(SITES["Fath1"]))
    keyword = atelier_keywords(spark, ["Fath1"]).where(F.col("atelier") == atelier).first().keyword
    path = os.path.join(d, f"MOV {keyword}.xlsx")
    with open(path, "wb") as fh:
        fh.write(sinks.workbook_bytes([("nowhere", [["Date", "REFERENCE", "STOCK"], ["1/1/2025", "a", 1]])]))
    got = verify(spark, spark.createDataFrame([("Fath1", "ledger", path)], "unit string, role string, path string")).where(F.col("atelier") == atelier).first()
    assert len(got.errors) == 1 and got.errors[0].endswith("not found") and got.detected_ref == "REFERENCE"


def test_positions_by_unit(spark):
    rows = [("s", "a", 0, "x", 1.0), ("s", "a", 0, "y", -5.0), ("s", "a", 1, "z", 9.0), ("s", "a", 0, "w", 1.0),
            ("t", "a", 0, "x", 1.0), ("t", "a", 0, "y", -5.0), ("t", "a", 1, "z", 5.0)]
    df = spark.createDataFrame([(*r, "discrepancy") for r in rows] + [("t", "a", 1, "m", 0.0, "match"), ("t", "a", 0, "n", 0.0, "match")],
                               "unit string, atelier string, job_idx int, Ref string, Difference double, status string").repartition(4)
    got = {}
    for r in positioned(df, {"s": "signed", "t": "abs"}).orderBy("position").collect():
        got.setdefault((r.unit, r.status), []).append(r.Ref)
    assert got == {("s", "discrepancy"): ["w", "x", "y", "z"], ("t", "discrepancy"): ["y", "z", "x"], ("t", "match"): ["n", "m"]}


def test_introduction_line(spark):
    units = spark.createDataFrame([("F",)], "unit string")
    lines = sorted((r.line_no, r.line) for r in report_heading(units, 2025, 3, "2025-04-02", intro="Differences of {month} {year}:").collect())
    assert [x for _, x in lines][-3:] == ["---", "Differences of March 2025:", "---"] and [i for i, _ in lines] == list(range(-6, 0))
