"""Registered queries over sheet grids: sheet choice, header rows, column
resolution, loaders.  The workbooks are renderings of lineitem (see
``sources.grids``); loader oracles aggregate lineitem directly, so they check
the whole grid -> header -> column -> clean -> aggregate path end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.numbers import coerce_number, qty_or_zero
from ledgerlens.functions.text import normalize_ref
from ledgerlens.operators import columns as C
from ledgerlens.operators import headers as H
from ledgerlens.operators import reconcile as R
from ledgerlens.operators.cutoff import cumulative_cutoff
from ledgerlens.operators.dates import parse_dates_auto
from ledgerlens.operators.loaders import extract
from ledgerlens.operators.sheets import restrict, sheet_by_keywords, sheet_from_candidates
from ledgerlens.plans import sql_grid as SG
from ledgerlens.plans.profiles import aliases
from ledgerlens.plans.registry import query
from ledgerlens.session import checked_broadcast, stage
from ledgerlens.sources import grids as G

KEYS = ["file_id", "sheet"]


def _ledger(spark, sf_dir):
    g = G.ledger_grid(spark, sf_dir)
    chosen = sheet_by_keywords(G.sheets_of(g), ["MOUV", "MOV"])
    return restrict(g, chosen.select("file_id", "sheet"))


def _hdr(h):
    return h.select(*KEYS, "header_idx", "found")


# --- sheet choice -------------------------------------------------------------

@query("sheet_list", SG.SHEET_LIST)
def sheet_list(spark, sf_dir):
    """S3: sheet names of every workbook, in workbook order."""
    return G.sheets_of(G.ledger_grid(spark, sf_dir))


@query("sheet_fallback", SG.SHEET_FALLBACK)
def sheet_fallback(spark, sf_dir):
    """First available sheet from an ordered candidate list (digits
    name a sheet position)."""
    g = G.ledger_grid(spark, sf_dir)
    sheets = G.sheets_of(g)
    jobs = sheets.select("file_id").distinct().select(
        F.lit("ledger").alias("job"), "file_id",
        F.array(F.lit("MOUVEMENT ATELIER"), F.lit("MOV"), F.lit("MOUVEMENT"), F.lit("0")).alias("candidates"))
    return sheet_from_candidates(sheets, jobs, ["job"])


@query("sheet_prefer", SG.SHEET_PREFER)
def sheet_prefer(spark, sf_dir):
    """First sheet whose name contains a preferred keyword, else the
    first sheet."""
    return sheet_by_keywords(G.sheets_of(G.ledger_grid(spark, sf_dir)), ["MOUV", "MOV", "STOCK"])


@query("sheet_exact", SG.SHEET_EXACT)
def sheet_exact(spark, sf_dir):
    """The sheet of exactly that name, else the first sheet."""
    return sheet_by_keywords(G.sheets_of(G.ledger_grid(spark, sf_dir)), ["MOUVEMENT"], exact=True)


# --- header rows --------------------------------------------------------------

@query("header_date", SG.HEADER_DATE)
def header_date(spark, sf_dir):
    """H1/H2/H8: first row of the sheet with an exact date-name cell."""
    return _hdr(H.header_by_alias(_ledger(spark, sf_dir), aliases("Fath1", "mov", "date")))


@query("header_label", SG.HEADER_LABEL)
def header_label(spark, sf_dir):
    """H7: first row with a label equal up to case and white space."""
    return _hdr(H.header_by_alias(_ledger(spark, sf_dir), ["LA   DATE", " Stocks "], normalize=True))


@query("header_ref_qty", SG.HEADER_REF_QTY)
def header_ref_qty(spark, sf_dir):
    """H8: first row with a reference or quantity name."""
    return _hdr(H.header_by_alias(_ledger(spark, sf_dir), ["REF", "REFERENCE", "Référence", "STOCK", "QTE"]))


@query("header_densest", SG.HEADER_DENSEST)
def header_densest(spark, sf_dir):
    """The row with the most non-empty cells, first on ties."""
    return _hdr(H.header_densest(_ledger(spark, sf_dir)))


@query("header_required", SG.HEADER_REQUIRED)
def header_required(spark, sf_dir):
    """H4: >= 2 required names, or any cell containing 'date'."""
    return _hdr(H.header_required(_ledger(spark, sf_dir), ["REF", "STOCKS", "LOCALISATION", "STOCK"]))


@query("header_tiered", SG.HEADER_TIERED)
def header_tiered(spark, sf_dir):
    """H5: 'date' substring / date alias, else ref or qty alias."""
    return _hdr(H.header_tiered(_ledger(spark, sf_dir), aliases("Larbaa", "mov", "date"),
                                aliases("Larbaa", "mov", "ref"), aliases("Larbaa", "mov", "quantity")))


@query("header_keywords", SG.HEADER_KEYWORDS)
def header_keywords(spark, sf_dir):
    """H6: >= 2 snapshot keywords inside upper-cased cells."""
    return _hdr(H.header_keywords(G.multi_sheet_grid(spark, sf_dir)))


# --- column resolution ----------------------------------------------------------

def _ledger_headers(spark, sf_dir, unit="Fath1"):
    g = _ledger(spark, sf_dir)
    h = H.header_tiered(g, aliases("Larbaa", "mov", "date"), aliases("Larbaa", "mov", "ref"),
                        aliases("Larbaa", "mov", "quantity"))
    return g, H.header_cells(g, h)


@query("resolve_exact", SG.RESOLVE_EXACT)
def resolve_exact(spark, sf_dir):
    """H9: first alias present verbatim (priority order) per role."""
    _, hc = _ledger_headers(spark, sf_dir)
    return hc.select(*KEYS, "header_idx",
                     C.resolve_exact("header", aliases("Fath2", "mov", "ref")).alias("ref_pos"),
                     C.resolve_exact("header", aliases("Fath2", "mov", "quantity")).alias("qty_pos"),
                     C.resolve_exact("header", aliases("Fath2", "mov", "date")).alias("date_pos"))


@query("resolve_casefold", SG.RESOLVE_CASEFOLD)
def resolve_casefold(spark, sf_dir):
    """Trimmed case-folded (and whitespace-collapsed) match."""
    _, hc = _ledger_headers(spark, sf_dir)
    return hc.select(*KEYS,
                     C.resolve_casefold("header", ["reference", "ref"]).alias("ref_pos"),
                     C.resolve_casefold("header", ["stock pv", "stocks", "stock"], collapse=True).alias("qty_pos"),
                     C.resolve_exact_then_casefold("header", ["DATE", "la date"]).alias("date_pos"))


@query("resolve_contains", SG.RESOLVE_CONTAINS)
def resolve_contains(spark, sf_dir):
    """First column containing an alias; configured quantity
    column matched both ways."""
    g = G.multi_sheet_grid(spark, sf_dir)
    hc = H.header_cells(g, H.header_keywords(g))
    custom = F.when(F.col("sheet") == "MAG N", "QUANTITE/KG").when(F.col("sheet") == "MAG R", "QUANTITE/M")
    return hc.select(*KEYS, "header_idx",
                     C.resolve_contains("header", aliases("Larbaa", "stock", "ref")).alias("ref_pos"),
                     F.coalesce(F.when(custom.isNotNull(), C.resolve_custom_col("header", custom)),
                                C.resolve_contains("header", aliases("Larbaa", "stock", "quantity"))).alias("qty_pos"),
                     C.resolve_date_fallback("header", aliases("Larbaa", "stock", "date")).alias("date_pos"))


@query("override_cols", SG.OVERRIDE_COLS)
def override_cols(spark, sf_dir):
    """Configured or user-chosen column names win when present;
    '-1' and blanks mean no override."""
    _, hc = _ledger_headers(spark, sf_dir)
    ovr = spark.createDataFrame([("MOV RO.xlsx", "DESIGNATION", "-1"), ("MOV AF.xlsx", "", "STOCK"),
                                 ("MOV NF.xlsx", "NO SUCH COLUMN", "LOCALISATION")],
                                "file_id string, ref_col string, qty_col string")
    j = hc.join(F.broadcast(ovr), "file_id", "left")
    return j.select(*KEYS,
                    C.override("header", F.col("ref_col"), C.resolve_exact("header", aliases("Fath2", "mov", "ref")))
                    .alias("ref_pos"),
                    C.override("header", F.col("qty_col"),
                               C.resolve_exact("header", aliases("Fath2", "mov", "quantity"))).alias("qty_pos"))


# --- loaders -----------------------------------------------------------------

@query("stock_load", "SELECT l_returnflag AS localisation, CAST(l_orderkey AS VARCHAR) AS Ref, "
       "CAST(ROUND(COALESCE(SUM(CAST(l_quantity AS DECIMAL(18,4))), 0), 2) AS DOUBLE) AS Stock_Qty "
       "FROM lineitem WHERE l_shipdate < DATE '1998-07-01' GROUP BY l_returnflag, l_orderkey")
def stock_load(spark, sf_dir):
    """Snapshot workbook -> preferred sheet -> densest header -> fixed
    columns -> cleaned lines -> SUM by (location, Ref)."""
    g = stage(G.stock_grid(spark, sf_dir), "grid-stock")
    chosen = sheet_by_keywords(G.sheets_of(g), ["STOCK"])
    g = restrict(g, chosen.select("file_id", "sheet"))
    hc = H.header_cells(g, H.header_densest(g))
    lines = extract(g, hc, {"ref": C.resolve_exact("header", aliases("Fath1", "stock", "ref")),
                            "qty": C.resolve_exact("header", aliases("Fath1", "stock", "quantity")),
                            "loc": C.resolve_exact("header", aliases("Fath1", "stock", "localisation"))})
    typed = lines.select(normalize_ref("ref").alias("ref"), coerce_number("qty").alias("qty"),
                         F.col("loc").alias("localisation"))
    out = R.aggregate_side(typed, ["localisation"], "Stock_Qty")
    return out.select("localisation", "Ref", F.col("Stock_Qty").cast("double").alias("Stock_Qty"))


MULTI_QTY = {"MAG A": "QUANTITE", "MAG N": "QUANTITE/KG", "MAG R": "QUANTITE/M"}


@query("stock_multi_sheet", "SELECT 'MAG ' || l_returnflag AS source_sheet, CAST(l_orderkey AS VARCHAR) AS Ref, "
       "CAST(ROUND(COALESCE(SUM(ROUND(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4)), 2)), 0), 2) "
       "AS DOUBLE) AS Stock_Qty FROM lineitem GROUP BY l_returnflag, l_orderkey")
def stock_multi_sheet(spark, sf_dir):
    """Listed snapshot sheets stacked with their source
    sheet kept; each sheet has its own header row and quantity column."""
    g = stage(G.multi_sheet_grid(spark, sf_dir), "grid-multi")
    listed = spark.createDataFrame([(G.MULTI_FILE, s, q) for s, q in MULTI_QTY.items()],
                                   "file_id string, sheet string, qty_name string")
    g = g.join(F.broadcast(listed), KEYS)
    hc = H.header_cells(g, H.header_keywords(g)).join(F.broadcast(listed), KEYS)
    lines = extract(g, hc, {"ref": C.resolve_contains("header", aliases("Larbaa", "stock", "ref")),
                            "qty": C.resolve_custom_col("header", F.col("qty_name"))})
    typed = lines.select(F.col("sheet").alias("source_sheet"), normalize_ref("ref").alias("ref"),
                         qty_or_zero("qty").alias("qty"))
    out = R.aggregate_side(typed, ["source_sheet"], "Stock_Qty", round_lines=2)
    return out.select("source_sheet", "Ref", F.col("Stock_Qty").cast("double").alias("Stock_Qty"))


@query("mov_stacked", "SELECT CAST(l_orderkey AS VARCHAR) AS Ref, "
       "CAST(ROUND(COALESCE(SUM(CAST(l_quantity AS DECIMAL(18,4))), 0), 2) AS DOUBLE) AS Calc_Mov_Qty "
       "FROM lineitem WHERE l_shipdate < DATE '1998-07-01' GROUP BY l_orderkey")
def mov_stacked(spark, sf_dir):
    """The two ledger sheets of a pair, each with its own
    header and date order, stacked and summed by Ref up to June 1998."""
    g = stage(G.paired_ledger_grid(spark, sf_dir), "grid-pair")
    al = {r: aliases("Larbaa", "mov", r) for r in ("date", "ref", "quantity")}
    hc = H.header_cells(g, H.header_tiered(g, al["date"], al["ref"], al["quantity"]))
    lines = extract(g, hc, {"ref": C.resolve_exact("header", al["ref"]),
                            "qty": C.resolve_exact("header", al["quantity"]),
                            "date": C.resolve_date_fallback("header", al["date"])})
    dated = parse_dates_auto(lines, KEYS, "date")
    typed = cumulative_cutoff(dated, 1998, 6).select(normalize_ref("ref").alias("ref"),
                                                      qty_or_zero("qty").alias("qty"))
    out = R.aggregate_side(typed, out="Calc_Mov_Qty")
    return out.select("Ref", F.col("Calc_Mov_Qty").cast("double").alias("Calc_Mov_Qty"))


@query("csv_sniff", "SELECT 'csv_' || l_returnflag || l_linestatus || '_' || CAST(l_orderkey // 1000 AS VARCHAR) "
       "AS file_id, CASE (l_orderkey // 1000) % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) ELSE '|' END "
       "AS sep, COUNT(*) + 1 AS n_rows, 'Qté' AS qty_header, CAST(SUM(l_orderkey) AS BIGINT) AS ref_sum "
       "FROM lineitem GROUP BY l_returnflag, l_linestatus, l_orderkey // 1000")
def csv_sniff(spark, sf_dir):
    """CSV ledgers with per-file delimiter, quoting and encoding
    (UTF-8 with BOM or code page 1252) parsed to grids; the detected
    delimiter, row count, decoded header and the parsed refs are reported."""
    from ledgerlens.operators.sinks import fresh_output
    from ledgerlens.sources.csv_grid import csv_grid, decoded, read_lines, sniff
    out = fresh_output(spark, "csv-ledgers")
    G.csv_ledger_files(spark, sf_dir, out)
    lines = read_lines(spark, out, "*").withColumn("file_id", F.substring_index("file_id", "path=", -1))
    text = decoded(lines)
    seps = checked_broadcast(sniff(text), "csv-separators")
    grid = csv_grid(text, seps)
    # the header text, a key first: numbers only in the aggregate, which hashes then
    at_top = F.when(F.col("row_idx") == 0, F.element_at("cells", 3)).alias("qty_header")
    parts = grid.groupBy("file_id", at_top).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("row_idx") > 0, F.element_at("cells", 2).try_cast("long"))).alias("ref_sum"))
    stats = parts.groupBy("file_id").agg(*[f(c).alias(c) for f, c in ((F.sum, "n_rows"), (F.max, "qty_header"), (F.sum, "ref_sum"))])
    return stats.join(seps, "file_id").select("file_id", "sep", "n_rows", "qty_header", "ref_sum")
