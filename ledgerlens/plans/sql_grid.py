"""Oracle-side (DuckDB SQL) versions of the rendered workbooks and of the
header / column rules, written independently of the Spark operators."""

from __future__ import annotations

from ledgerlens.plans.sql_adapters import SQL_WS, sql_strip


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join("NULL" if v is None else _q(v) for v in values) + "]"


_DATA = ("SELECT 'MOV ' || l_returnflag || l_linestatus || '.xlsx' AS file_id, "
         "CASE l_linestatus WHEN 'F' THEN 'MOUVEMENT' ELSE 'MOV' END AS sheet, "
         "CAST(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 4 END + l_orderkey * 8 + l_linenumber "
         "AS BIGINT) AS row_idx, "
         "CASE l_returnflag WHEN 'R' THEN [ref, des, d, qty, l_returnflag] ELSE [d, ref, des, qty, l_returnflag] "
         "END AS cells FROM (SELECT *, strftime(CAST(l_shipdate AS DATE), '%-d/%-m/%Y') AS d, "
         "CAST(l_orderkey AS VARCHAR) AS ref, 'part ' || CAST(l_partkey AS VARCHAR) AS des, "
         "CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS qty FROM lineitem) x")
_N5 = [None] * 4
_TOP = [("A", 0, ["Suivi des mouvements"] + _N5), ("A", 1, ["Date", "REFERENCE", "DESIGNATION", "STOCK", "LOCALISATION"]),
        ("N", 0, ["LA DATE", "Référence", "DESIGNATION", "STOCK PV", "LOCALISATION"]),
        ("R", 0, ["Suivi des mouvements"] + _N5), ("R", 1, [None] * 5), ("R", 2, ["Unité de production"] + _N5),
        ("R", 3, ["REF", "DESIGNATION", "DATE", "STOCKS", "LOCALISATION"])]
_TOP_SQL = ("SELECT 'MOV ' || f.rf || f.ls || '.xlsx' AS file_id, "
            "CASE f.ls WHEN 'F' THEN 'MOUVEMENT' ELSE 'MOV' END AS sheet, CAST(t.row_idx AS BIGINT) AS row_idx, "
            "CAST(t.cells AS VARCHAR[]) AS cells FROM (SELECT DISTINCT l_returnflag AS rf, l_linestatus AS ls "
            "FROM lineitem) f JOIN (VALUES " + ", ".join(f"({_q(k)}, {i}, {lst(c)})" for k, i, c in _TOP)
            + ") t(rf, row_idx, cells) ON f.rf = t.rf")
# the ledger sheet of every movement workbook (the sheet the preference rule picks)
LEDGER_GRID = f"{_DATA} UNION ALL {_TOP_SQL}"
LEDGER_SHEETS = ("SELECT DISTINCT 'MOV ' || l_returnflag || l_linestatus || '.xlsx' AS file_id, "
                 "CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS sheet_pos, "
                 "CASE l_linestatus WHEN 'F' THEN 'MOUVEMENT' ELSE 'MOV' END AS sheet FROM lineitem "
                 "UNION ALL SELECT DISTINCT 'MOV ' || l_returnflag || l_linestatus || '.xlsx', 0, 'NOTES' "
                 "FROM lineitem WHERE l_linestatus = 'F'")

_MULTI = {"A": ("MAG A", ["Inventaire magasin A"], ["REFERENCE", "DESIGNATION", "QUANTITE"]),
          "N": ("MAG N", [], ["REF", "QUANTITE/KG"]),
          "R": ("MAG R", ["Inventaire", "magasin R"], ["Ref produit", "Désignation", "QUANTITE/M"])}
_MULTI_TOP = []
for _k, (_name, _titles, _hdr) in _MULTI.items():
    for _i, _t in enumerate(_titles):
        _MULTI_TOP.append((_name, _i, [_t] + [None] * (len(_hdr) - 1)))
    _MULTI_TOP.append((_name, len(_titles), _hdr))
MULTI_GRID = ("SELECT 'STOCK MAGASINS.xlsx' AS file_id, 'MAG ' || l_returnflag AS sheet, "
              "CAST(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 3 END + l_orderkey * 8 + l_linenumber "
              "AS BIGINT) AS row_idx, CASE l_returnflag WHEN 'N' THEN [ref, v] ELSE [ref, des, v] END AS cells "
              "FROM (SELECT *, CAST(l_orderkey AS VARCHAR) AS ref, 'part ' || CAST(l_partkey AS VARCHAR) AS des, "
              "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM lineitem) x "
              "UNION ALL SELECT 'STOCK MAGASINS.xlsx', sheet, CAST(row_idx AS BIGINT), CAST(cells AS VARCHAR[]) "
              "FROM (VALUES " + ", ".join(f"({_q(s)}, {i}, {lst(c)})" for s, i, c in _MULTI_TOP)
              + ") t(sheet, row_idx, cells)")


def present(cells: str = "cells") -> str:
    return f"list_transform(list_filter({cells}, lambda x: x IS NOT NULL), lambda x: {sql_strip('x')})"


def first_header(grid: str, pred: str, max_rows: int | None = None, pred2: str | None = None) -> str:
    """(file_id, sheet, header_idx, found) - first qualifying row, else the
    first scanned row."""
    scan = f"(SELECT * FROM {grid} WHERE row_idx < {max_rows})" if max_rows is not None else grid
    hit = f"MIN(CASE WHEN {pred} THEN row_idx END)"
    if pred2:
        hit = f"COALESCE({hit}, MIN(CASE WHEN {pred2} THEN row_idx END))"
    return (f"SELECT file_id, sheet, COALESCE({hit}, MIN(row_idx)) AS header_idx, {hit} IS NOT NULL AS found "
            f"FROM {scan} g GROUP BY file_id, sheet")


def has_any(values: str, names) -> str:
    return f"COALESCE(list_has_any({values}, {lst(names)}), false)"


def contains_date(values: str) -> str:
    return f"COALESCE(list_bool_or(list_transform({values}, lambda v: contains(lower(v), 'date'))), false)"


def pos_exact(h: str, names) -> str:
    parts = [f"CASE WHEN list_contains({h}, {_q(n)}) THEN CAST(list_position({h}, {_q(n)}) - 1 AS INTEGER) END"
             for n in names]
    return "COALESCE(" + ", ".join(parts) + ")"


def pos_casefold(h: str, names, collapse: bool = False) -> str:
    if collapse:
        collapsed = "regexp_replace(x, '" + SQL_WS + "+', ' ', 'g')"
        norm = f"list_transform({h}, lambda x: lower({sql_strip(collapsed)}))"
        keys = [" ".join(str(n).split()).lower() for n in names]
    else:
        norm = f"list_transform({h}, lambda x: lower({sql_strip('x')}))"
        keys = [str(n).strip().lower() for n in names]
    parts = [f"CASE WHEN list_contains({norm}, {_q(k)}) THEN CAST(len({norm}) - "
             f"list_position(list_reverse({norm}), {_q(k)}) AS INTEGER) END" for k in keys]
    return "COALESCE(" + ", ".join(parts) + ")"


def pos_contains(h: str, names) -> str:
    ups = [n.upper() for n in names]
    flags = f"list_transform({h}, lambda x: COALESCE(list_bool_or(list_transform({lst(ups)}, lambda a: contains(upper({sql_strip('x')}), a))), false))"
    return f"CAST(NULLIF(list_position({flags}, true), 0) - 1 AS INTEGER)"


def pos_date_fallback(h: str, names) -> str:
    flags = f"list_transform({h}, lambda x: COALESCE(contains(lower(x), 'date'), false))"
    return f"COALESCE({pos_exact(h, names)}, CAST(NULLIF(list_position({flags}, true), 0) - 1 AS INTEGER))"


# --- complete oracle statements ---------------------------------------------------
# The header names of some units by side and role, written out
# here so that the oracle does not read the lists it checks.
_NAMES = {
    ('Fath1', 'mov', 'date'): ['Date', 'DATE', 'date'],
    ('Fath1', 'mov', 'ref'): ['Référence\nFournisseur', 'REFERENCE', 'reference', 'Référence', 'Référence\n'],
    ('Fath1', 'mov', 'quantity'): ['STOCK PV', 'STOCK', 'STOCKS', 'ST-P', 'ST-PV'],
    ('Fath2', 'mov', 'date'): ['Date', 'DATE', 'date'],
    ('Fath2', 'mov', 'ref'): ['Row Labels', 'Référence\nFournisseur', 'REFERENCE', 'reference', 'Référence', 'REF', 'REF PRODUIT'],
    ('Fath2', 'mov', 'quantity'): ['Quantité', 'STOCK PV', 'STOCK', 'STOCKS', 'ST-P', 'STOKS'],
    ('Fath3', 'mov', 'date'): ['Date', 'DATE', 'date', 'التاريخ'],
    ('Fath3', 'mov', 'ref'): ['PRODOUITE', 'PRODUIT', 'REF', 'REFERENCE', 'REFERENCE ', 'Référence', 'REF PRODUIT'],
    ('Fath3', 'mov', 'quantity'): ['Q ST PV', 'Q ST PV ', 'Quantité', 'STOCK PV', 'STOCK'],
    ('Larbaa', 'mov', 'date'): ['Date', 'DATE', 'date', 'LA DATE'],
    ('Larbaa', 'mov', 'ref'): ['Row Labels', 'Référence (Bir Khadem)', 'Référence\nFournisseur', 'REFERENCE', 'RÉFÉRENCE', 'reference', 'Référence', 'REF', 'Ref', 'REF PRODUIT', 'REFERANCE', 'PRODUIT', 'REFFERENCE', 'réfferance'],
    ('Larbaa', 'mov', 'quantity'): ['SOMME', 'Quantité', 'STOCK PV', 'STOCK', 'STOCKS', 'ST-P', 'STOKS', 'Stock', 'Stock(Kg)', ' Quantité', 'STOCK KG', 'STOCKS KG', 'STOCKS M', 'stock'],
    ('Mags', 'mov', 'date'): ['Date', 'DATE', 'date', 'التاريخ'],
    ('Mags', 'mov', 'ref'): ['REFERENCE', 'REFERANCE', 'REFERENCe', 'Référence', 'REF', 'REF PRODUIT', 'Row Labels', 'Référence\nFournisseur', 'reference', 'referance', 'REFERNCE', 'البيان', 'المرجع', 'نوع', 'التعيين'],
    ('Mags', 'mov', 'quantity'): ['QUANTITE', 'Quantité', 'QTE', 'QTY', 'STOCK', 'STOCKS', 'STOCK ', 'ST-P', 'STOKS', 'STOCK U', 'STOCK/M', 'STOCK POIDS', 'STOCK PV', 'STOCK FIBRE ', 'باقي', 'Q-STOCKS', 'المخزون', 'الكمية', 'العدد'],
    ('Larbaa', 'stock', 'date'): ['Date', 'DATE', 'date'],
    ('Larbaa', 'stock', 'ref'): ['REFERENCE', 'Référence', 'REF', 'reference'],
    ('Larbaa', 'stock', 'quantity'): ['QUANTITE/KG', 'QUANTITE KG', 'QUANTITE', 'Quantité', 'QTE', 'STOCK'],
}


def _al(unit: str, side: str, role: str) -> list[str]:
    return _NAMES[unit, side, role]


_G = f"WITH g AS ({LEDGER_GRID})\n"
_S = f"WITH s AS ({LEDGER_SHEETS})\n"

SHEET_LIST = LEDGER_SHEETS
SHEET_FALLBACK = (_S + ", c AS (SELECT * FROM (VALUES (0, 'MOUVEMENT ATELIER'), (1, 'MOV'), (2, 'MOUVEMENT'), "
                  "(3, '0')) v(k, cand)), f AS (SELECT DISTINCT file_id FROM s) "
                  "SELECT 'ledger' AS job, f.file_id, arg_min(s.sheet, CASE WHEN s.sheet IS NOT NULL THEN c.k END) "
                  "AS sheet FROM f CROSS JOIN c LEFT JOIN s ON s.file_id = f.file_id AND (s.sheet = c.cand OR "
                  "(regexp_matches(c.cand, '^[0-9]+$') AND s.sheet_pos = TRY_CAST(c.cand AS INTEGER))) "
                  "GROUP BY f.file_id")
SHEET_PREFER = (_S + ", k AS (SELECT * FROM (VALUES (0, 'MOUV'), (1, 'MOV'), (2, 'STOCK')) v(i, w)), "
                "pref AS (SELECT s.file_id, arg_min(s.sheet, k.i * 100000 + s.sheet_pos) AS p FROM s JOIN k "
                "ON contains(upper(s.sheet), k.w) GROUP BY s.file_id), "
                "fst AS (SELECT file_id, arg_min(sheet, sheet_pos) AS f FROM s GROUP BY file_id) "
                "SELECT fst.file_id, COALESCE(p, f) AS sheet, p IS NOT NULL AS preferred "
                "FROM fst LEFT JOIN pref ON fst.file_id = pref.file_id")

SHEET_EXACT = (_S + "SELECT file_id, COALESCE(arg_min(sheet, sheet_pos) FILTER (WHERE upper(sheet) = 'MOUVEMENT'), "
               "arg_min(sheet, sheet_pos)) AS sheet, bool_or(upper(sheet) = 'MOUVEMENT') AS preferred FROM s GROUP BY file_id")

_LABELS = "list_transform(list_filter(cells, lambda x: x IS NOT NULL), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))))"
HEADER_LABEL = _G + first_header("g", has_any(_LABELS, ["la date", "stocks"]))
HEADER_REF_QTY = _G + first_header("g", has_any(present(), ["REF", "REFERENCE", "Référence", "STOCK", "QTE"]))

HEADER_DATE = _G + first_header("g", has_any(present(), _al("Fath1", "mov", "date")))
_N_CELLS = "len(list_filter(cells, lambda x: x IS NOT NULL))"
HEADER_DENSEST = (_G + f"SELECT file_id, sheet, arg_max(row_idx, {_N_CELLS} * 1000000000000 - row_idx) "
                  "AS header_idx, true AS found FROM g GROUP BY file_id, sheet")
_REQ = ["REF", "STOCKS", "LOCALISATION", "STOCK"]
HEADER_REQUIRED = _G + first_header(
    "g", f"(len(list_intersect({present()}, {lst(_REQ)})) >= 2 OR {contains_date(present())})")
_T12 = f"({contains_date(present())} OR {has_any(present(), _al('Larbaa', 'mov', 'date'))})"
_T3 = f"({has_any(present(), _al('Larbaa', 'mov', 'ref'))} OR {has_any(present(), _al('Larbaa', 'mov', 'quantity'))})"
HEADER_TIERED = _G + first_header("g", _T12, pred2=_T3)
_KW = ["REFERENCE", "DESIGNIATION", "DATE", "QUANTITE", "REF"]
_UP = f"list_transform({present()}, lambda v: upper(v))"
_HITS = " + ".join(f"CAST(COALESCE(list_bool_or(list_transform({_UP}, lambda v: contains(v, {_q(k)}))), false) AS INTEGER)"
                   for k in _KW)
HEADER_KEYWORDS = f"WITH g AS ({MULTI_GRID})\n" + first_header("g", f"({_HITS}) >= 2")

_TIERED_HC = (_G + f", h AS ({first_header('g', _T12, pred2=_T3)}), "
              "hc AS (SELECT h.file_id, h.sheet, h.header_idx, g.cells AS header FROM h JOIN g "
              "ON g.file_id = h.file_id AND g.sheet = h.sheet AND g.row_idx = h.header_idx)\n")
RESOLVE_EXACT = (_TIERED_HC + f"SELECT file_id, sheet, header_idx, {pos_exact('header', _al('Fath2', 'mov', 'ref'))} "
                 f"AS ref_pos, {pos_exact('header', _al('Fath2', 'mov', 'quantity'))} AS qty_pos, "
                 f"{pos_exact('header', _al('Fath2', 'mov', 'date'))} AS date_pos FROM hc")
RESOLVE_CASEFOLD = (_TIERED_HC + f"SELECT file_id, sheet, {pos_casefold('header', ['reference', 'ref'])} AS ref_pos, "
                    f"{pos_casefold('header', ['stock pv', 'stocks', 'stock'], collapse=True)} AS qty_pos, "
                    f"COALESCE({pos_exact('header', ['DATE', 'la date'])}, "
                    f"{pos_casefold('header', ['DATE', 'la date'])}) AS date_pos FROM hc")


def _custom(name: str) -> str:
    flags = (f"list_transform(header, lambda x: COALESCE(contains({_q(name.upper())}, upper(trim(x))) "
             f"OR contains(upper(trim(x)), {_q(name.upper())}), false))")
    return f"CAST(NULLIF(list_position({flags}, true), 0) - 1 AS INTEGER)"


RESOLVE_CONTAINS = (f"WITH g AS ({MULTI_GRID}), h AS ({first_header('g', f'({_HITS}) >= 2')}), "
                    "hc AS (SELECT h.file_id, h.sheet, h.header_idx, g.cells AS header FROM h JOIN g "
                    "ON g.file_id = h.file_id AND g.sheet = h.sheet AND g.row_idx = h.header_idx)\n"
                    f"SELECT file_id, sheet, header_idx, {pos_contains('header', _al('Larbaa', 'stock', 'ref'))} "
                    f"AS ref_pos, CASE sheet WHEN 'MAG N' THEN {_custom('QUANTITE/KG')} WHEN 'MAG R' THEN "
                    f"{_custom('QUANTITE/M')} ELSE {pos_contains('header', _al('Larbaa', 'stock', 'quantity'))} "
                    f"END AS qty_pos, {pos_date_fallback('header', _al('Larbaa', 'stock', 'date'))} AS date_pos FROM hc")


def _override(col: str, fallback: str) -> str:
    ok = f"(o.{col} IS NOT NULL AND {sql_strip(f'o.{col}')} <> '' AND o.{col} <> '-1')"
    return (f"COALESCE(CASE WHEN {ok} AND list_contains(header, o.{col}) THEN "
            f"CAST(list_position(header, o.{col}) - 1 AS INTEGER) END, {fallback})")


OVERRIDE_COLS = (_TIERED_HC.rstrip("\n") + ", o AS (SELECT * FROM (VALUES ('MOV RO.xlsx', 'DESIGNATION', '-1'), "
                 "('MOV AF.xlsx', '', 'STOCK'), ('MOV NF.xlsx', 'NO SUCH COLUMN', 'LOCALISATION')) "
                 "v(file_id, ref_col, qty_col))\n"
                 f"SELECT hc.file_id, hc.sheet, {_override('ref_col', pos_exact('header', _al('Fath2', 'mov', 'ref')))} "
                 f"AS ref_pos, {_override('qty_col', pos_exact('header', _al('Fath2', 'mov', 'quantity')))} AS qty_pos "
                 "FROM hc LEFT JOIN o ON hc.file_id = o.file_id")


# --- verification / diagnostics / export --------------------------------------------

def _date_hdr_cells(files_pred: str = "true", max_rows: int | None = None) -> str:
    pred = has_any(present(), _al("Fath1", "mov", "date"))
    return (f"h AS ({first_header(f'(SELECT * FROM g WHERE {files_pred})', pred, max_rows)}), "
            "hc AS (SELECT h.file_id, h.sheet, h.header_idx, h.found, g.cells AS header FROM h JOIN g "
            "ON g.file_id = h.file_id AND g.sheet = h.sheet AND g.row_idx = h.header_idx)")


_JOINED = "array_to_string(list_transform(header, lambda x: COALESCE(x, '')), ', ')"


def _missing_msg(ref: str, qty: str) -> str:
    missing = f"list_filter([CASE WHEN {ref} IS NULL THEN 'ref' END, CASE WHEN {qty} IS NULL THEN 'qty' END], " \
              "lambda x: x IS NOT NULL)"
    return (f"'Could not find ' || array_to_string({missing}, '/') || ' column. Available: ' || {_JOINED}", missing)


_F1_REF = pos_exact("header", _al("Fath1", "mov", "ref"))
_F1_QTY = pos_exact("header", _al("Fath1", "mov", "quantity"))
_MSG, _MISSING = _missing_msg(_F1_REF, _F1_QTY)

DIAGNOSTICS_UNITS = (f"WITH g AS ({LEDGER_GRID}), " + _date_hdr_cells("sheet = 'MOUVEMENT'") + "\n"
                     f"SELECT 'Fath1' AS unit, substr(file_id, 5, 1) || '/' || file_id || '/' || sheet AS scope, "
                     "'error' AS severity, "
                     f"'MISSING_COLUMN' AS code, {_MSG} AS message FROM hc WHERE len({_MISSING}) > 0")

DIAGNOSTICS = (f"WITH g AS ({LEDGER_GRID}), " + _date_hdr_cells() + "\n"
               f"SELECT file_id || '/' || sheet AS scope, 'error' AS severity, 'MISSING_COLUMN' AS code, "
               f"{_MSG} AS message FROM hc WHERE len({_MISSING}) > 0 "
               "UNION ALL SELECT 'X', 'error', 'MISSING_INPUT', 'no stock snapshot'")


def _verify_units() -> str:
    """Every ledger file under the names of four units: the first listed sheet
    that the workbook has, else an error and its first sheet; the header is the
    first row with a date name, else the first row; the first name of each
    list among the columns; a missing date column is no error."""
    sheets = {"Fath1": ["MOUVEMENT"], "Fath3": ["ABSENT", "MOV"], "Larbaa": ["0"], "Mags": []}
    rows = ", ".join("(" + ", ".join([_q(u), lst(c) if c else "CAST([] AS VARCHAR[])", *[lst(_al(u, "mov", r)) for r in ("date", "ref", "quantity")]]) + ")"
                     for u, c in sheets.items())
    pick = lambda names: f"list_filter({names}, lambda a: list_contains(header, a))[1]"
    notes = ("SELECT DISTINCT 'MOV ' || l_returnflag || l_linestatus || '.xlsx', 'NOTES', CAST(0 AS BIGINT), "
             "['Remarques', 'fichier MOV ' || l_returnflag || l_linestatus || '.xlsx'] FROM lineitem WHERE l_linestatus = 'F'")
    return (f"WITH g AS ({LEDGER_GRID} UNION ALL {notes}), s AS ({LEDGER_SHEETS}), "
            f"u AS (SELECT * FROM (VALUES {rows}) v(unit, cands, dates, refs, qtys)), "
            "av AS (SELECT file_id, list_sort(list_distinct(list(sheet))) AS available_sheets, arg_min(sheet, sheet_pos) AS first_sheet FROM s GROUP BY file_id), "
            "j AS (SELECT u.*, substr(av.file_id, 5, 1) AS atelier, av.file_id, available_sheets, "
            "list_filter(cands, lambda c: list_contains(available_sheets, c))[1] AS hit, first_sheet FROM av, u), "
            "k AS (SELECT *, COALESCE(hit, first_sheet) AS sheet FROM j), "
            f"m AS (SELECT k.unit, k.file_id, COALESCE(min(g.row_idx) FILTER (WHERE len(list_intersect({present()}, k.dates)) > 0), min(g.row_idx)) AS header_idx "
            "FROM k JOIN g ON g.file_id = k.file_id AND g.sheet = k.sheet GROUP BY k.unit, k.file_id), "
            "x AS (SELECT k.*, g.cells AS header FROM k JOIN m USING (unit, file_id) JOIN g ON g.file_id = k.file_id AND g.sheet = k.sheet AND g.row_idx = m.header_idx), "
            f"y AS (SELECT *, {pick('refs')} AS detected_ref, {pick('qtys')} AS detected_qty, {pick('dates')} AS detected_date FROM x), "
            "z AS (SELECT *, list_filter([CASE WHEN hit IS NULL AND len(cands) > 0 THEN 'Sheet ''' || cands[1] || ''' not found' END, "
            "CASE WHEN detected_ref IS NULL THEN 'Reference column not found' END, "
            "CASE WHEN detected_qty IS NULL THEN 'Quantity column not found' END], lambda e: e IS NOT NULL) AS errors FROM y)\n"
            "SELECT unit, atelier, file_id AS filename, len(errors) = 0 AS valid, errors, available_sheets, "
            "list_filter(header, lambda c: c IS NOT NULL) AS available_columns, cands AS expected_sheets, sheet AS checked_sheet, "
            "detected_ref, detected_qty, detected_date FROM z")


VERIFY_FILES = _verify_units()
