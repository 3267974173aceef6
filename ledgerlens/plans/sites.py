"""Atelier job configuration of the nine units, as data.

``SITES`` keeps each unit's configuration in its natural (nested) form;
``job_rows`` expands nested groups into one row per (unit, atelier, job) and
``jobs_frame`` exposes them as a DataFrame, which the pipeline joins to the
grids.  Adding an atelier or a unit means adding entries here.

Keys of an entry: ``sheets`` - ledger sheet candidates (a nested list means
one job per group; ``0`` names the first sheet by position); ``locations`` -
snapshot locations (tuples are (LOCAL, LOCALISATION) pairs, nested lists one
group per job); ``stock_sheets`` / ``stock_qty`` - snapshot sheets per job
and their quantity column; ``mov_cols`` - (ref, qty) override columns, -1
meaning "no override"; ``keyword`` - file-name keyword when it differs from
the atelier name; ``exclude`` - excluded locations; ``must_contain`` - header
names; ``no_loc_col`` - the ledger has no location column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Per-unit atelier configuration, in the units' own order.
SITES: dict[str, dict[str, dict]] = {
    "Fath1": {
        "femme 01": {"sheets": ["الحركة اليومية"], "locations": ["ATELIER COUTURE FEMME 01"]},
        "femme 02": {"sheets": ["الحركة اليومية"], "locations": ["ATELIER COUTURE FEMME 02"]},
        "bourde": {"sheets": ["MOVEMENT BORDI"], "locations": ["ATT COUPAGE BOURDEE"]},
        "coupage": {"sheets": ["MOVEMENT"], "locations": ["ATELIER DE COUPAGE A", "ATELIER DE COUPAGE B",
                                                          "ATT COUPAGE ROULER", "ATELIER DE ROULOUX & ACCOUDOIRE"]},
        "+croute": {"sheets": ["MOUVMENT"], "locations": ["ATELIER DE DECHETS"]},
        "grattage+": {"sheets": ["MOUVEMENT"], "locations": ["ATELIER DE DECHETS"]},
        "produt": {"sheets": ["MOVEMMENT"], "locations": ["ATT- PRODUIT EL FATH 01"]},
        "-grattage": {"sheets": ["ATT GRATTAGE"], "locations": ["ATTELIER GRATTAGE A", "ATTELIER GRATTAGE B",
                                                                "ATT GRATTAGE C", "ATT GRATTAGE BORDER",
                                                                "ATT GRATTAGE ROULER"]},
        "rouler": {"sheets": ["MOVEMENT ROLI"], "locations": ["ATT  ROULER"]},
        "conftection rouli": {"sheets": ["MOUVEMENT ATELIER CONFECTION"], "locations": ["ATTELIER CONFECTION ROULI"]},
        "brodri": {"sheets": ["MOUVEMENT"], "locations": ["ATTELIER BRODRIE", "ATTELIER BRODERI"]},
        "conftection bourdi": {"sheets": ["MOUVEMENT ATELIER CONFECTION"], "locations": ["ATELIER CONFECTION BOURDI"]},
        "fiber cardi": {"sheets": ["الحركة اليومية"], "locations": ["ATTELLIER  FIBER CARDI"]},
        "orielle": {"sheets": ["الحركة اليومية"], "locations": ["ATTELIER D'ORIELLER"]},
        "bloc": {"sheets": ["MOUVEM 09"], "locations": ["MAGASINE DE BLOCS"]},
        "magaza bourdi": {"sheets": ["مخزن البوردي (بلاستيك+ساكوشة)"], "locations": ["MAGASIN BOURDI"]},
        "secondaire": {"sheets": ["MAGASIN"], "locations": ["MAGASIN SECONDAIRE(FATH1)"]},
        "mov-com": {"sheets": ["MOV"], "locations": ["MAGASIN COMMERCIAL"]},
    },
    "Fath2": {
        "ouate 01": {"sheets": ["الحركة اليومية"], "locations": ["ATT OUATE 01"]},
        "ouate 02": {"sheets": ["الحركة اليومية"], "locations": ["ATT OUATE 02"]},
        "sfifa": {"sheets": ["MOUVEMENT 2024"], "locations": ["ATT SFIFA", "MGZ TRANSFERT"]},
        "mgz plasic": {"sheets": ["MOVEMENT MAGASAIN PLASTIQUE"], "locations": ["MGZ PLASTIG"]},
        "secondaire": {"sheets": ["MOUV"], "locations": ["MAG UNITE"]},
        "-dechet": {"sheets": ["MOUVEMENT"], "locations": ["MAG DECHET"]},
        "commercial": {"sheets": ["MOUVEMENT"], "locations": ["SERVICE COMMERCIAL"]},
        "فيبر": {"sheets": ["حركة الفيبر اليومية"], "locations": [" ateliers FIBRE cardi"]},
        "plastique": {"sheets": ["MOVEMONTE DE ATT PLASTIQUE", "MOVEMONTE"], "locations": ["ATELIER PLASTIQUE"]},
        "tissu": {"sheets": ["MOUVEMENT 2024"], "locations": ["ATT- TISSU"]},
    },
    "Fath3": {
        "pet": {"keyword": "pet", "sheets": ["MOUV PARC03-2023"],
                "must_contain": ["Date", "LOCALITATION", "PRODOUITE", "Q ST PV"],
                "mov_cols": ["PRODOUITE", "Q ST PV"],
                "exclude": ["ATT TRIAGE"]},
        "triage": {"keyword": "triage", "sheets": ["MOUVM"], "must_contain": ["DATE", "PRODUIT", "STOCK"],
                   "mov_cols": ["PRODUIT", "STOCK"], "locations": ["ATT TRIAGE"], "no_loc_col": True},
    },
    "Fath5": {
        "bonda": {"sheets": ["ATELLIER COUATE"], "locations": ["ATELIER BONDA 3D"]},
        "orillier": {"sheets": ["MOV"], "locations": ["ATELIER CONFECTION D'ORILLIER"]},
        "confiction": {"sheets": ["ATT CONFECTION"], "locations": ["ATELIER CONFICTION"]},
        "couette fini": {"sheets": ["ATELLIER COUATE"], "locations": ["ATTELLIER COUETTE  FINI"]},
        "semi fini": {"sheets": ["ATELLIER COUATE"], "locations": ["ATELIER COUETTE SEMI FINI"]},
        "rouli": {"sheets": ["MOV"], "locations": ["ATELIER MATELAS ROULI "]},
        "block": {"sheets": ["MOUV"], "locations": ["MAGASIN DE BLOCK"]},
        "gratage": {"sheets": ["MOUV"], "locations": ["ATELIER GRATTAGE"]},
        "coupage": {"sheets": ["MOUV"], "locations": ["ATELIER COUPAGE"]},
        "comersial": {"sheets": ["MOV"], "locations": ["MAGASIN COMMERCIAL"]},
        "secondaire": {"sheets": ["MAG"], "locations": ["MAGASIN SECONDAIRE EL FATEH 05"], "mov_cols": [-1, "Q-STOCKS"]},
        "ouate": {"sheets": ["MOUV"], "locations": ["ATELIER OUATE"]},
        "outin": {"sheets": ["MOUVEMENT"], "locations": ["ATELIER OUATENAGE"]},
    },
    "Larbaa": {
        "atelier découpage": {"sheets": [" ATT-DECOUPAGE"], "stock_sheets": ["ATT DECOUPAGE"]},
        "coupage ": {"sheets": ["ATT COUPAGE", "ATT-COUP"], "stock_sheets": ["ATT COUPAGE"]},
        "roulés.entré": {"sheets": ["Entré Mousse"], "stock_sheets": ["ATT MATELAS ROULEE 01"]},
        "roulés.sortie": {"sheets": [["Sortie Atelier 01", "Matière consommable"]],
                          "stock_sheets": [["ATT MATELAS ROULEE 01"]]},
        "oreiller": {"sheets": ["OR"], "stock_sheets": ["ATT ORIELE", "MAG COUETTE+ORIELE"]},
        "couette": {"sheets": ["co", "COUETTE"], "stock_sheets": ["MAG COUETTE+ORIELE"]},
        "magasin blocs": {"sheets": ["Mouvements", "Mouvement"], "stock_sheets": ["STOCK BLOCK"]},
        "magasin fibre": {"sheets": ["Mouvements"], "stock_sheets": ["STOCK FIBRE"]},
        "magasin ouate": {"sheets": ["Magasin Ouate"], "stock_sheets": ["MAG OUATE"]},
        "magasin mousse": {"sheets": [" MOUVEMENT01"], "stock_sheets": ["MAG MOUSSE"]},
        "magasin roules": {"sheets": ["Roulés"], "stock_sheets": ["MAG ROULEE"]},
        "grattage": {"sheets": ["MAG DE GRATAG"], "stock_sheets": ["ATT-GRATTAGE"]},
        "accessoire": {"sheets": ["Mouvements"], "stock_sheets": ["MAGASN CENTRAL"]},
        "piec": {"sheets": ["Sheet1"], "stock_sheets": ["PIECE"]},
        "(ouate": {"sheets": [["Opérations Ouate"], ["Opération Cardinage"], ["Opérations Ouatinage"]],
                   "stock_sheets": [["ATT-PROD OUATE"], ["ATT-FIBRE CARDEE"], ["ATT-OUATINAGE"]],
                   "stock_qty": [["QUANTITE/KG"], ["QUANTITE KG"], ["QUANTITE/M"]]},
        "sortie mousse couture": {"sheets": ["Sortie Mouse Couture", "Sortie Mousse Couture"],
                                  "stock_sheets": ["ATT COUPAGE COUTURE"]},
        " pet ": {"sheets": ["MOUVMENT", "MOUVEMENT"], "stock_sheets": ["PET"]},
    },
    "Oran": {
        "block": {"sheets": ["Movement Block"], "stock_sheets": ["Stock Block"]},
        "mousse": {"sheets": ["Movement Magasin mousse"], "stock_sheets": ["STOCK MOUSSE"]},
        "rouléss": {"sheets": ["Movement Roulés"], "stock_sheets": ["STOCK ROULE"]},
        "cardage": {"sheets": ["Atelier Cardage"], "stock_sheets": ["STOCK FIBER"]},
    },
    "Fibre": {
        "drafter": {"sheets": ["Drafter"], "locations": [("At-Fibre2", "DRAFTER")]},
        "extredeuse": {"sheets": ["ATELLIER COUATE"], "locations": [("At-Fibre2", "EXTREDEUSE")]},
        "filiére": {"sheets": ["ATELLIER COUATE"], "locations": [("At-Fibre2", "Filiére")]},
        "carding": {"sheets": ["الحركةاليومية"], "locations": ["AT-CARDING"], "mov_cols": ["Référence", "Quantité"]},
        "magaisain pet": {"sheets": ["Mouvement"], "locations": ["MAGASIN-PET"], "mov_cols": ["Référence", "Quantité"]},
        "magaisain fibre": {"sheets": [["MOUVEMENT"], ["UNITE ETPH"]], "locations": [["MAGASIN"], ["MAGASIN-LAROBI"]],
                            "mov_cols": [["REF PRODUIT", "Quantité"], ["REF PRODUIT", "S REEL"]]},
        "magaisain commercial": {"sheets": ["Mouvement"], "locations": ["MAGASIN-Commerciale"],
                                 "mov_cols": ["Référence", "Quantity"]},
    },
    "Mdoukal": {
        "couture femmes": {"sheets": ["STC"], "locations": ["ATELIER COUTURE FEMME"], "mov_cols": ["REFERENCE", "STOCK"]},
        "orielles": {"sheets": ["Sheet1"], "locations": ["ATELIER PREPARATION ORIELLES FINI"],
                     "mov_cols": ["REFERENCE", "STOCK"]},
        "magasin": {"sheets": ["MOV"], "locations": ["MAGASIN PRINCIPAL UNITE M'DOUKEL"], "mov_cols": ["REFERENCE", "STOCK"]},
    },
    "Mags": {
        "magz": {"sheets": ["MOUV", "MOV", "MAG", 0]},
    },
}

JOB_DDL = ("unit string, atelier string, job_idx int, file_keyword string, candidates array<string>, "
           "stack_sheets boolean, stock_sheets array<string>, stock_qty_col string, "
           "locations array<string>, location_pairs array<struct<local:string,localisation:string>>, "
           "exclude array<string>, ref_col string, qty_col string, must_contain array<string>, "
           "no_loc_col boolean")


def _nested(v) -> bool:
    return isinstance(v, list) and any(isinstance(x, list) for x in v)


def _col(v):
    return None if v is None or v == -1 else str(v)


def job_rows(unit: str) -> list[tuple]:
    """Expand one unit's configuration into job rows (nested groups -> jobs)."""
    rows = []
    for atelier, cfg in SITES[unit].items():
        sheets, locs = cfg.get("sheets", []), cfg.get("locations")
        stock_sheets, mov_cols = cfg.get("stock_sheets"), cfg.get("mov_cols")
        multi = _nested(sheets) and (not stock_sheets or _nested(stock_sheets) or _nested(locs))
        n = len(sheets) if multi else 1
        for j in range(n):
            cand = sheets[j] if multi else sheets
            loc = locs[j] if (multi and _nested(locs)) else locs
            st = stock_sheets[j] if (multi and stock_sheets and _nested(stock_sheets)) else stock_sheets
            mc = mov_cols[j] if (multi and mov_cols and _nested(mov_cols)) else mov_cols
            qty = cfg.get("stock_qty")
            qty = qty[j][0] if (qty and multi) else None
            plain = [str(x) for x in (loc or []) if not isinstance(x, tuple)]
            pairs = [(a, b) for a, b in (x for x in (loc or []) if isinstance(x, tuple))]
            rows.append((unit, atelier, j, cfg.get("keyword", atelier), [str(c) for c in cand],
                         bool(multi and len(cand) > 1), [str(s) for s in (st or [])] or None, qty,
                         plain or None, pairs or None, cfg.get("exclude"),
                         _col(mc[0]) if mc else None, _col(mc[1]) if mc else None,
                         cfg.get("must_contain"), bool(cfg.get("no_loc_col", False))))
    return rows


def jobs_frame(spark: SparkSession, units=None) -> DataFrame:
    units = units or list(SITES)
    return spark.createDataFrame([r for u in units for r in job_rows(u)], JOB_DDL)
