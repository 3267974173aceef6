"""Date-order detection, serial-date gate, greedy file matching."""

import random
import statistics

import pandas as pd
import pytest

from ledgerlens.operators import dates as D
from ledgerlens.operators import matching as M


def detect(spark, values):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file_id string, row_idx long, v string")
    return D.detect_date_order(df, ["file_id"], "v").first()["date_order"]


def test_detection_votes_and_ties(spark):
    assert detect(spark, ["13/02/2025", "01/02/2025"]) == "eu"
    assert detect(spark, ["02/13/2025", "01/02/2025"]) == "us"
    assert detect(spark, ["13/02/2025", "02/13/2025"]) == "eu"                  # tie -> eu
    assert detect(spark, ["2025-01-02", "2025-01-03", "01/02/2025"]) == "iso"     # >= 50 % ISO
    assert detect(spark, ["2025-01-02", "01/02/2025", "03/04/2025"]) == "eu"
    assert detect(spark, ["  ", None]) == "unknown"


def test_detection_counts_every_value(spark):
    vals = ["01/02/2025"] * 200 + ["02/13/2025"] * 50
    assert detect(spark, vals) == "us"


@pytest.mark.parametrize("seed", range(6))
def test_serial_gate_equals_pandas_median(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for f in range(20):
        n = rnd.randint(1, 9)
        center = rnd.choice([10000, 20000, 40000, 60000, 70000])
        vals = [center + rnd.choice([-1, 1]) * rnd.randint(0, 3) * rnd.choice([1, 1000, 5000]) for _ in range(n)]
        if rnd.random() < 0.15:
            vals[0] = "abc"
        rows += [(f"f{f}", str(v)) for v in vals]
    df = spark.createDataFrame(rows, "file_id string, v string")
    got = {r["file_id"]: r["is_serial"] for r in D.serial_date_columns(df, ["file_id"], "v").collect()}
    pdf = pd.DataFrame(rows, columns=["file_id", "v"])
    for f, g in pdf.groupby("file_id"):
        num = pd.to_numeric(g["v"], errors="coerce")
        expect = bool(num.notna().all() and 20000 <= statistics.median(num) <= 60000)
        assert got[f] == expect, (f, list(g["v"]))


def _files(spark, names):
    return spark.createDataFrame([("U", n, n, i) for i, n in enumerate(names)],
                                 "unit string, path string, file_name string, file_pos int")


def _ateliers(spark, kws):
    return spark.createDataFrame([("U", k, k, i) for i, k in enumerate(kws)],
                                 "unit string, atelier string, keyword string, atelier_pos int")


def test_greedy_policies_differ(spark):
    files = _files(spark, ["mov coupage femme.xlsx", "mov femme 01.xlsx"])
    ateliers = _ateliers(spark, ["femme", "coupage"])
    ff = {r["atelier"]: r["path"] for r in M.assign(files, ateliers, "files_first").collect()}
    af = {r["atelier"]: r["path"] for r in M.assign(files, ateliers, "ateliers_first").collect()}
    assert ff == {"femme": "mov coupage femme.xlsx"}                 # coupage's only file is taken
    assert af == {"femme": "mov coupage femme.xlsx"}
    files2 = _files(spark, ["mov femme 01.xlsx", "mov coupage femme.xlsx"])
    ff2 = {r["atelier"]: r["path"] for r in M.assign(files2, ateliers, "files_first").collect()}
    assert ff2 == {"femme": "mov femme 01.xlsx", "coupage": "mov coupage femme.xlsx"}


def test_word_matching_and_unmatched(spark):
    files = _files(spark, ["MOV conftection bourdi 2025.xlsx", "notes.xlsx"])
    ateliers = _ateliers(spark, ["conftection  rouli", "bourdi conftection ", "bloc"])
    got = {r["atelier"]: r["path"] for r in M.assign(files, ateliers, "ateliers_first").collect()}
    assert got == {"bourdi conftection ": "MOV conftection bourdi 2025.xlsx"}
    um = {(r["kind"], r["name"]) for r in M.unmatched(files, ateliers, M.assign(files, ateliers)).collect()}
    assert ("file", "notes.xlsx") in um and ("atelier", "bloc") in um


def test_dates_through_a_dictionary_equal_dates_by_line(spark, monkeypatch):
    from ledgerlens.operators import dates as D
    rows = [(f"f{i % 3}", i, v) for i, v in enumerate(
        ["13/02/2024", "02/13/2024", "2024-02-13", " 1/2/2024", "", None, "30/02/2024", "x", "5/6/2024 10:00"] * 9)] + [("g", 0, None)]
    df = spark.createDataFrame(rows, "file_id string, n int, v string")

    def run():
        return sorted(map(repr, D.parse_dates_auto(df, ["file_id"], "v").select("file_id", "n", "date_order", "mov_date").collect()))
    one = run()
    monkeypatch.setattr(D, "DICTIONARY_ROWS", 1)
    assert one == run() and len(one) == len(rows)


def test_month_names_are_made_of_distinct_months(spark):
    """The texts of file names and their regexes are computed per month, not
    per order: no filter on them stands in front of the distinct."""
    from conftest import SF_SMALL
    from ledgerlens.plans.catalog import QUERIES
    for name in ("snapshot_roles", "filename_period"):
        plan = QUERIES[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "orders.parquet" not in plan


def test_unmatched_assigns_once(spark):
    """The greedy assignment is computed once, not for each side."""
    from conftest import SF_SMALL
    from ledgerlens.plans.catalog import QUERIES
    plan = QUERIES["unmatched"].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "part.parquet" not in plan


def test_serial_dates_are_parsed_once_per_text(spark):
    """Dates come from the distinct texts, rows of a null group and repeats of
    a value included (its repeats count for the median)."""
    from ledgerlens.operators.dates import coerce_dates
    rows = [("s", "45000")] * 3 + [("s", "1"), ("s", None), ("s", " ")] + [("t", "1")] * 3 + [("t", "45000"), (None, "2/1/2024"), ("t", "3/1/2024")]
    out = coerce_dates(spark.createDataFrame(rows, "f string, v string"), ["f"], "v")
    assert "RLike" not in out._jdf.queryExecution().optimizedPlan().toString() and "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((str(r.f), str(r.v), str(r.mov_date)) for r in out.collect())
    assert got == sorted([("s", "45000", "2023-03-15")] * 3 + [("s", "1", "1899-12-31"), ("s", "None", "None"), ("s", " ", "None")]
                         + [("t", "1", "None")] * 3 + [("t", "45000", "None"), ("None", "2/1/2024", "2024-01-02"), ("t", "3/1/2024", "2024-01-03")])
