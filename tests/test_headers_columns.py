"""Header-row rules and column resolution on hand-written grids."""

from pyspark.sql import functions as F

from conftest import grid_df
from ledgerlens.operators import columns as C
from ledgerlens.operators import headers as H


def hdr(df):
    r = df.first()
    return r["header_idx"], r["found"]


def test_date_alias_after_title_rows(spark):
    g = grid_df(spark, [["Rapport"], [None, "x"], ["Période"], [" Date ", "REFERENCE", "STOCK"], ["1/1/2025", "A", "1"]])
    assert hdr(H.header_by_alias(g, ["Date", "DATE"])) == (3, True)
    assert hdr(H.header_by_alias(g, ["Date"], max_rows=3)) == (0, False)


def test_densest_first_wins_ties(spark):
    g = grid_df(spark, [["t"], ["a", "b", "c"], ["1", "2", "3"], ["x", None, "z"]])
    assert hdr(H.header_densest(g))[0] == 1


def test_required_or_date_substring(spark):
    g = grid_df(spark, [["titre"], ["RF", "x"], ["mise a jour"], ["RF", "S REEL", "LOCALISATION"]])
    assert hdr(H.header_required(g, ["RF", "S REEL", "LOCALISATION"])) == (3, True)
    # any cell containing 'date' (case-folded) qualifies, even inside a word
    g1 = grid_df(spark, [["titre"], ["Updated"], ["RF", "S REEL", "LOCALISATION"]])
    assert hdr(H.header_required(g1, ["RF", "S REEL", "LOCALISATION"])) == (1, True)
    g2 = grid_df(spark, [["titre"], ["la date du jour"], ["RF", "S REEL"]])
    assert hdr(H.header_required(g2, ["RF", "S REEL", "LOCALISATION"])) == (1, True)


def test_tiered(spark):
    g = grid_df(spark, [["x"], ["REF", "STOCK"], ["DATE MVT", "REF"]])
    assert hdr(H.header_tiered(g, ["Date"], ["REF"], ["STOCK"])) == (2, True)
    g2 = grid_df(spark, [["x"], ["y", "REF"], ["z", "STOCK"]])
    assert hdr(H.header_tiered(g2, ["Date"], ["REF"], ["STOCK"])) == (1, True)
    g3 = grid_df(spark, [["x"], ["y"]])
    assert hdr(H.header_tiered(g3, ["Date"], ["REF"], ["STOCK"])) == (0, False)


def test_keywords_as_substrings(spark):
    g = grid_df(spark, [["inventaire"], ["REFERENCE PRODUIT", "QUANTITE/KG"]])
    assert hdr(H.header_keywords(g)) == (1, True)


def test_resolvers(spark):
    df = spark.createDataFrame([(["Date", "Référence\nFournisseur", "stock ", " STOCK", "REF PRODUIT", None],)],
                               "header array<string>")
    r = df.select(
        C.resolve_exact("header", ["REFERENCE", "Référence\nFournisseur"]).alias("exact"),
        C.resolve_casefold("header", ["stock"]).alias("casefold_last"),
        C.resolve_casefold("header", ["référence fournisseur"], collapse=True).alias("collapsed"),
        C.resolve_contains("header", ["REF"]).alias("contains"),
        C.resolve_custom_col("header", F.lit("STOCK KG")).alias("custom"),
        C.override("header", F.lit("-1"), F.lit(9)).alias("sentinel"),
        C.override("header", F.lit("REF PRODUIT"), F.lit(9)).alias("override"),
        C.resolve_date_fallback("header", ["DATE"]).alias("date_fb"),
    ).first()
    assert r["exact"] == 1
    assert r["casefold_last"] == 3
    assert r["collapsed"] == 1
    assert r["contains"] == 4          # "RÉFÉRENCE" does not contain "REF"
    assert r["custom"] == 2
    assert r["sentinel"] == 9 and r["override"] == 4
    assert r["date_fb"] == 0


def test_header_far_down_and_none_at_all(spark):
    """The search goes on by stretches, per sheet, until the header or the end."""
    import pyspark.sql.functions as F

    from ledgerlens.operators import headers as H
    body = spark.range(100_500).select(F.lit("f.xlsx").alias("file_id"), F.lit(0).alias("sheet_pos"), F.explode(F.array(
        *[F.lit(s) for s in ("early", "late", "none")])).alias("sheet"), F.col("id").alias("row_idx"))
    mark = F.when((F.col("sheet") == "early") & (F.col("row_idx") == 3) | (F.col("sheet") == "late") & (F.col("row_idx") == 100_000), "Date").otherwise("x")
    ref = F.when((F.col("sheet") == "none") & (F.col("row_idx") == 9_000) | (F.col("sheet") == "late") & (F.col("row_idx") == 5), "REF")
    grid = body.select("*", F.array(mark, ref).alias("cells")).where("sheet <> 'none' or row_idx >= 200")
    got = {r.sheet: (r.header_idx, r.found, r.header) for r in H.header_by_alias(grid, ["Date"]).collect()}
    assert got == {"early": (3, True, ["Date", None]), "late": (100_000, True, ["Date", None]), "none": (200, False, ["x", None])}
    # a row of the first tier wins however far below one of the second
    got = {r.sheet: (r.header_idx, r.found) for r in H.header_tiered(grid, ["Date"], ["REF"], ["QTY"]).collect()}
    assert got == {"early": (3, True), "late": (100_000, True), "none": (9_000, True)}
    assert H.header_by_alias(grid.limit(0), ["Date"]).collect() == []


def test_rounds_of_the_search_are_bounded(spark):
    """Rows numbered far apart: the rounds do not grow with the numbers, and
    a round is a hash aggregate that carries no cells."""
    from ledgerlens.operators import headers as H

    rows = [("f.xlsx", 0, s, i, [v, None]) for s, v in (("late", "Date"), ("none", "y")) for i, v in ((7, "x"), (8, None), (10**12, v), (10**12, "z"))]
    grid = spark.createDataFrame(rows, "file_id string, sheet_pos int, sheet string, row_idx bigint, cells array<string>")
    rounds = lambda: sum("header-hits" in p for p in spark.sparkContext._ledgerlens_scratch)
    spark.sparkContext.__dict__.setdefault("_ledgerlens_scratch", [])
    before = rounds()
    got = {r.sheet: (r.header_idx, r.found, r.header) for r in H.header_by_alias(grid, ["Date", "DATE"]).collect()}
    # of two rows of one number, the one that holds the name
    assert got == {"late": (10**12, True, ["Date", None]), "none": (7, False, ["x", None])}
    assert rounds() - before <= 3


def test_densest_counts_blank_and_missing_cells(spark):
    from ledgerlens.operators import headers as H

    rows = [("f", 0, "S", 5, ["a", None, "b"]), ("f", 0, "S", 9, ["", "c", None]), ("f", 0, "S", 4, ["d", None, None]),
            ("f", 0, "T", 3, ["a", "b"]), ("f", 0, "T", 2, ["", "b"]), ("f", 0, "T", None, ["a", "b", "c"]), ("f", 0, "T", 1, None)]
    grid = spark.createDataFrame(rows, "file_id string, sheet_pos int, sheet string, row_idx bigint, cells array<string>")
    picked = H.header_densest(grid)
    assert {(r.sheet, r.header_idx, tuple(r.header)) for r in picked.collect()} == {("S", 5, ("a", None, "b")), ("T", 2, ("", "b"))}
