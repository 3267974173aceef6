"""Site profiles as data: the per-unit rule matrix and column alias lists.

Adding a site means adding rows here (or loading the same tables from
storage); no operator code changes.  ``profile_frame`` is the rule matrix as a
table, from which ``plans.run.process`` takes its rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column-name aliases per unit, side and role, in priority order.
_DATE = ["Date", "DATE", "date"]
_DATE_AR = ["Date", "DATE", "date", "التاريخ"]
_REF_WIDE = ["Row Labels", "Référence\nFournisseur", "REFERENCE", "reference", "Référence", "REF", "REF PRODUIT",
             "referance", "البيان", "المرجع", "نوع", "REFERNCE", "التعيين"]
_QTY_WIDE = ["Quantité", "STOCK PV", "STOCK FIBRE ", "STOCK", "STOCK ", "STOCKS", "ST-P", "STOKS", "STOCK U",
             "المخزون", "الكمية", "العدد", "STOCK/M", "STOCK POIDS", "باقي", "Q-STOCKS"]

ALIASES: dict[str, dict[str, dict[str, list[str]]]] = {
    "Fath1": {"mov": {"date": _DATE,
                      "ref": ["Référence\nFournisseur", "REFERENCE", "reference", "Référence", "Référence\n"],
                      "quantity": ["STOCK PV", "STOCK", "STOCKS", "ST-P", "ST-PV"]},
              "stock": {"ref": ["REFERENCE"], "quantity": ["QUANTITE"], "localisation": ["LOCALISATION"]}},
    "Fath2": {"mov": {"date": _DATE,
                      "ref": ["Row Labels", "Référence\nFournisseur", "REFERENCE", "reference", "Référence", "REF",
                              "REF PRODUIT"],
                      "quantity": ["Quantité", "STOCK PV", "STOCK", "STOCKS", "ST-P", "STOKS"]},
              "stock": {"ref": ["REFERENCE"], "quantity": ["QUANTITE"], "localisation": ["LOCALISATION"]}},
    "Fath3": {"mov": {"date": _DATE_AR,
                      "localisation": ["LOCALITATION", "LOCALISATION", "LOCALISATION "],
                      "ref": ["PRODOUITE", "PRODUIT", "REF", "REFERENCE", "REFERENCE ", "Référence", "REF PRODUIT"],
                      "quantity": ["Q ST PV", "Q ST PV ", "Quantité", "STOCK PV", "STOCK"]},
              "stock": {"ref": ["RF", "RF ", "REF", "REFERENCE", "REFERENCE "],
                        "quantity": ["S REEL", "S REEL ", "S RÉEL", "QUANTITE", "QUANTITÉ"],
                        "localisation": ["LOCALISATION", "LOCALISATION "]}},
    "Fath5": {"mov": {"date": _DATE_AR, "ref": _REF_WIDE, "quantity": _QTY_WIDE},
              "stock": {"ref": ["REF"], "quantity": ["QUANTITE", "QUANT"], "localisation": ["LOCALISATION"]}},
    "Larbaa": {"mov": {"date": ["Date", "DATE", "date", "LA DATE"],
                       "ref": ["Row Labels", "Référence (Bir Khadem)", "Référence\nFournisseur", "REFERENCE",
                               "RÉFÉRENCE", "reference", "Référence", "REF", "Ref", "REF PRODUIT", "REFERANCE",
                               "PRODUIT", "REFFERENCE", "réfferance"],
                       "quantity": ["SOMME", "Quantité", "STOCK PV", "STOCK", "STOCKS", "ST-P", "STOKS", "Stock",
                                    "Stock(Kg)", " Quantité", "STOCK KG", "STOCKS KG", "STOCKS M", "stock"]},
               "stock": {"date": _DATE, "ref": ["REFERENCE", "Référence", "REF", "reference"],
                         "quantity": ["QUANTITE/KG", "QUANTITE KG", "QUANTITE", "Quantité", "QTE", "STOCK"]}},
    "Oran": {"mov": {"date": _DATE_AR, "ref": _REF_WIDE,
                     "quantity": ["Q"] + _QTY_WIDE + ["Q(U)", "q(u)", "Q-REEL", "Somme de Q(U)", "U"]},
             "stock": {"ref": ["référence", "reference", "ref"],
                       "quantity": ["q-reel", "somme de q(u)", "q(u)", "Q", "u", "q-logicial", "q-logiciale"]}},
    "Fibre": {"mov": {"date": _DATE_AR, "ref": _REF_WIDE, "quantity": _QTY_WIDE},
              "stock": {"ref": ["PRODUIT"], "quantity": ["S REEL"], "local": ["LOCAL"],
                        "localisation": ["LOCALISATION"]}},
    "Mdoukal": {"mov": {"date": _DATE_AR, "ref": _REF_WIDE, "quantity": _QTY_WIDE},
                "stock": {"ref": ["REF"], "quantity": ["QUANTITE"], "localisation": ["LOCALISATION"]}},
    "Mags": {"mov": {"date": _DATE_AR,
                     "ref": ["REFERENCE", "REFERANCE", "REFERENCe", "Référence", "REF", "REF PRODUIT", "Row Labels",
                             "Référence\nFournisseur", "reference", "referance", "REFERNCE", "البيان", "المرجع",
                             "نوع", "التعيين"],
                     "quantity": ["QUANTITE", "Quantité", "QTE", "QTY", "STOCK", "STOCKS", "STOCK ", "ST-P", "STOKS",
                                  "STOCK U", "STOCK/M", "STOCK POIDS", "STOCK PV", "STOCK FIBRE ", "باقي",
                                  "Q-STOCKS", "المخزون", "الكمية", "العدد"]},
             "stock": {"ref": ["REFERENCE", "REFERANCE", "REFERENCe", "Référence", "REF", "REF PRODUIT"],
                       "quantity": ["QUANTITE", "Quantité", "QTE", "QTY", "STOCK"]}},
}

# Parts of column names that some units accept, in priority
# order, instead of their listed names or after them.
NAME_PARTS: dict[str, dict[str, dict]] = {
    "Oran": {"ref": {"after_names": False, "parts": [["référence", "reference"], ["ref"]]},
             "quantity": {"after_names": True, "parts": [["quantité", "quantite", "qty", "stock", "q(u)"]]}},
}

# The rule matrix, one row per unit.
#   stock_sheet: 'prefer:<kw>,<kw>' (substring preference, else first sheet),
#                'exact:<name>' (else first), 'listed' (the job's own sheets), 'candidates:<a>,<b>,<pos>'
#   header: densest | date_alias | required | keywords | tiered | ref_or_qty
#   resolve: exact | casefold | exact_casefold | contains (exact, else substring) | substring | collapse
#   period: none | cumulative | exact_month ; match: exact | tolerance ; order: signed | abs
PROFILE_COLUMNS = ("unit", "stock_sheet", "stock_header", "stock_resolve", "stock_null_qty", "stock_round",
                   "mov_header", "mov_header_rows", "mov_resolve", "date_order", "period", "mov_round",
                   "location_rule", "match", "order")
PROFILES = [
    ("Fath1", "prefer:STOCK", "densest", "exact", "skip", None, "date_alias", None, "exact", "dmy", "none", None,
     "stock_in", "exact", "signed"),
    ("Fath2", "prefer:MOV,STOCK", "date_alias", "exact", "zero", 2, "date_alias", None, "exact", "mdy",
     "cumulative", 2, "stock_in", "exact", "signed"),
    ("Fath3", "exact:STOCKS", "required", "exact_casefold", "zero_locale", 4, "required", None, "exact_casefold",
     "serial_dmy", "cumulative", None, "in_not_in", "tolerance", "signed"),
    ("Fath5", "prefer:MOUV,MOV,STOCK", "date_alias", "contains", "zero", 2, "date_alias", None, "exact", "mdy",
     "cumulative", 2, "stock_in", "exact", "signed"),
    ("Larbaa", "listed", "keywords", "substring", "zero", 2, "tiered", None, "exact", "auto", "cumulative", None,
     "sheet", "exact", "abs"),
    ("Oran", "listed", "densest", "collapse", "zero", None, "date_alias_norm", None, "collapse", "mdy",
     "cumulative", None, "sheet", "exact", "signed"),
    ("Fibre", "exact:STOCKS GLOBALE", "date_alias", "casefold", "zero", 2, "date_alias", None, "casefold", "mdy",
     "cumulative", 2, "local_or_pairs", "exact", "abs"),
    ("Mdoukal", "exact:MOUV", "date_alias", "contains", "zero", 2, "date_alias", None, "exact", "mdy",
     "cumulative", 2, "stock_in", "tolerance", "signed"),
    ("Mags", "candidates:MOUV,MOV,MAG,0", "ref_or_qty", "exact", "zero", 2, "date_alias", None, "exact", "mdy",
     "exact_month", 2, "none", "tolerance", "signed"),
]


def profile_frame(spark: SparkSession) -> DataFrame:
    schema = ", ".join(f"{c} {'int' if c in ('stock_round', 'mov_round', 'mov_header_rows') else 'string'}"
                       for c in PROFILE_COLUMNS)
    return spark.createDataFrame(PROFILES, schema)


def aliases(unit: str, side: str, role: str) -> list[str]:
    return list(ALIASES[unit][side].get(role, []))


def ledger_names(spark: SparkSession, units) -> DataFrame:
    """(unit, date, ref, quantity): the ledger header names of the units."""
    return spark.createDataFrame([(u, *[aliases(u, "mov", r) for r in ("date", "ref", "quantity")]) for u in units],
                                 "unit string, date array<string>, ref array<string>, quantity array<string>")
