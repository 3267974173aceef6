"""End-to-end run: snapshot grids + ledger grids + site configuration -> results.

Each unit's rules (``plans.profiles``) choose the sheet rule, header rule,
column resolver, date order, period filter, rounding, location rule and
match rule; each job row (``plans.sites``, joined with the file assigned to
its atelier) supplies sheet candidates, location lists and column
overrides.  Every job of every unit flows through the same operators and the
units are unioned into one plan keyed by ``(unit, atelier, job_idx)``.
Failures (no sheet, no ref / qty column) are rows of ``diagnostics`` and
never stop the other jobs.

The Python-side loop is over *units* (nine rule sets), never over data.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_dayfirst, parse_monthfirst
from ledgerlens.functions.numbers import QTY, coerce_locale_number, coerce_number, qty_or_zero
from ledgerlens.functions.text import normalize_ref, ref_key, strip_text
from ledgerlens.operators import columns as C
from ledgerlens.operators import headers as H
from ledgerlens.operators import reconcile as R
from ledgerlens.operators.dates import coerce_dates, parse_dates_auto
from ledgerlens.operators.loaders import computed, extract, missing_columns
from ledgerlens.operators.rollforward import rollforward
from ledgerlens.operators.sheets import sheet_by_keywords, sheet_from_candidates
from ledgerlens.plans.profiles import NAME_PARTS, PROFILE_COLUMNS, PROFILES, aliases
from ledgerlens.session import checked_broadcast
from ledgerlens.sources.grids import sheets_of

JOB_KEYS = ["unit", "atelier", "job_idx"]
G_KEYS = ["file_id", "sheet"]
# Snapshot header names of the required-names rule.
STOCK_REQUIRED = ["RF", "S REEL", "LOCALISATION"]
# A column position past every row: reads as empty cells.
BEYOND = 2_000_000_000


@dataclass
class UnitRules:
    unit: str
    stock_sheet: str = "prefer:STOCK"
    stock_header: str = "densest"
    stock_resolve: str = "exact"
    stock_null_qty: str = "zero"
    stock_round: int | None = None
    mov_header: str = "date_alias"
    mov_header_rows: int | None = None
    mov_resolve: str = "exact"
    date_order: str = "dmy"
    period: str = "cumulative"
    mov_round: int | None = None
    location_rule: str = "stock_in"
    match: str = "exact"
    order: str = "signed"
    tolerance: float = 0.02
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_profile(cls, unit: str, **overrides) -> "UnitRules":
        row = dict(zip(PROFILE_COLUMNS, next(p for p in PROFILES if p[0] == unit)))
        row.pop("unit")
        row.update(overrides)
        return cls(unit=unit, **row)


# --- resolution helpers -------------------------------------------------------

def _resolver(how: str, names: list[str]) -> Column:
    if how == "casefold":
        return C.resolve_casefold("header", names)
    if how == "collapse":
        return C.resolve_casefold("header", names, collapse=True)
    if how == "exact_casefold":
        return C.resolve_exact_then_casefold("header", names)
    if how == "contains":
        return F.coalesce(C.resolve_exact("header", names), C.resolve_contains("header", names))
    if how == "substring":
        return C.resolve_contains("header", names)
    return C.resolve_exact("header", names)


def _stock_resolver(r: UnitRules, role: str, names: list[str]) -> Column:
    """The unit's resolver; some units look for parts of a name instead of,
    or after, the listed names."""
    parts = NAME_PARTS.get(r.unit, {}).get(role)
    if not parts:
        return _resolver(r.stock_resolve, names)
    found = [C.resolve_contains("header", p) for p in parts["parts"]]
    return F.coalesce(*([_resolver(r.stock_resolve, names)] if parts["after_names"] else []), *found)


def _mov_roles(r: UnitRules) -> dict[str, Column]:
    al = {k: aliases(r.unit, "mov", k) for k in ("date", "ref", "quantity", "localisation")}
    date = (C.resolve_date_fallback("header", al["date"]) if r.mov_header == "tiered"
            else _resolver(r.mov_resolve, al["date"]))
    roles = {"ref": C.override("header", F.col("ref_col"), _resolver(r.mov_resolve, al["ref"])),
             "qty": C.override("header", F.col("qty_col"), _resolver(r.mov_resolve, al["quantity"])),
             "date": date}
    if al["localisation"]:
        roles["loc"] = _resolver(r.mov_resolve, al["localisation"])
    return roles


def _headers(grid: DataFrame, rule: str, r: UnitRules, side: str, keys, max_rows=None) -> DataFrame:
    al = {k: aliases(r.unit, side, k) for k in ("date", "ref", "quantity")}
    if side == "stock" and not al["date"]:
        al["date"] = aliases(r.unit, "mov", "date")
    if rule == "densest":
        h = H.header_densest(grid, keys, max_rows)
    elif rule == "date_alias_norm":
        h = H.else_densest(H.header_by_alias(grid, al["date"], keys, max_rows, normalize=True), grid, keys)
    elif rule == "tiered":
        h = H.header_tiered(grid, al["date"], al["ref"], al["quantity"], keys, max_rows)
    elif rule == "keywords":
        h = H.header_keywords(grid, keys=keys, max_rows=max_rows)
    elif rule == "ref_or_qty":
        h = H.header_by_alias(grid, al["ref"] + al["quantity"], keys, max_rows)
    elif rule == "required":
        if side == "mov":
            h = H.header_required_col(grid, "must_contain", keys, max_rows)
        else:
            h = H.header_required(grid, STOCK_REQUIRED, keys, max_rows)
    else:
        h = H.header_by_alias(grid, al["date"], keys, max_rows)
    return h


# --- ledger side ----------------------------------------------------------------

def ledger_sheets(mov_grid: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job keys, file_id, sheet): first available candidate, or every
    available candidate for stacked jobs."""
    sheets = checked_broadcast(sheets_of(mov_grid), "sheet-list")
    single = sheet_from_candidates(sheets, jobs.where(~F.col("stack_sheets")), JOB_KEYS)
    st = jobs.where(F.col("stack_sheets")).select(*JOB_KEYS, "file_id", F.explode("candidates").alias("sheet"))
    stacked = st.join(sheets, ["file_id", "sheet"], "left_semi")
    return single.unionByName(stacked.select(*JOB_KEYS, "file_id", "sheet"))


def missing_sheets(chosen: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row per job none of whose sheets is in its ledger (``chosen``: the
    sheets of ``ledger_sheets`` that are)."""
    found = chosen.select(*JOB_KEYS)
    names = F.array_join(F.transform("candidates", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    return jobs.join(found.distinct(), JOB_KEYS, "left_anti").select(
        "unit", F.concat_ws("/", "atelier", "file_id").alias("scope"), F.lit("error").alias("severity"),
        F.lit("MISSING_SHEET").alias("code"),
        F.concat(F.lit("Could not find any of the sheets ["), names, F.lit("]")).alias("message"))


def _bad(text: str, value: Column) -> Column:
    """A cell that holds something no value came of."""
    return (F.coalesce(strip_text(F.col(text).cast("string")), F.lit("")) != "") & value.isNull()


def line_warnings(lines: DataFrame, scope: list[str], **flags: Column) -> DataFrame:
    """Counts of lines with a blank ref or an unreadable quantity or date, one
    aggregate per unit; a row per scope and kind that occurs."""
    codes = {"ref": ("BLANK_REF", "line(s) without reference"), "number": ("BAD_QUANTITY", "unreadable quantity cell(s), counted as 0"),
             "date": ("BAD_DATE", "unreadable date cell(s)")}
    counts = lines.groupBy("unit", *scope).agg(*[F.sum(f.cast("long")).alias(f"_{k}") for k, f in flags.items()])
    kinds = F.array(*[F.struct(F.lit(codes[k][0]).alias("code"), F.col(f"_{k}").alias("n"), F.lit(codes[k][1]).alias("what")) for k in flags])
    return (counts.select("unit", *scope, F.explode(kinds).alias("x")).where(F.col("x.n") > 0)
            .select("unit", F.concat_ws("/", *scope).alias("scope"), F.lit("warning").alias("severity"), F.col("x.code").alias("code"),
                    F.concat_ws(" ", F.col("x.n").cast("string"), F.col("x.what")).alias("message")))


def movement_lines(mov_grid: DataFrame, jobs: DataFrame, r: UnitRules, year: int, month: int):
    """Typed ledger lines ``(unit, atelier, job_idx, ref, qty, mov_date,
    localisation)``, diagnostics, and the jobs whose ledger could be read."""
    ujobs = jobs.where(F.col("unit") == r.unit)
    chosen = ledger_sheets(mov_grid, ujobs).where(F.col("sheet").isNotNull())
    jcols = ujobs.select(*JOB_KEYS, "ref_col", "qty_col", "must_contain", "no_loc_col")
    # one row per (sheet, job), from the grid's sheet list: joined by its checked size
    per_job = checked_broadcast(chosen.join(jcols, JOB_KEYS), "sheets")
    keys = [*G_KEYS, *JOB_KEYS]
    rows = mov_grid.join(per_job, G_KEYS)
    hdr = _headers(rows, r.mov_header, r, "mov", keys, r.mov_header_rows)
    hc = hdr.join(per_job, keys)
    # one row per (sheet, job) with its header: written once, read by the
    # diagnostics, the job list and the body
    hc = checked_broadcast(hc, "ledger-headers")
    roles = _mov_roles(r)
    needed = ["ref", "qty"]
    if r.mov_header == "required":
        needed += ["date"]
        if "loc" in roles:  # unless the job's ledger has no such column
            needed += ["loc"]
            roles["loc"] = F.coalesce(roles["loc"], F.when(F.col("no_loc_col"), F.lit(BEYOND)))
    diag = missing_columns(hc, roles, needed, keys).select(
        "unit", F.concat_ws("/", "atelier", "file_id", "sheet").alias("scope"), "severity", "code", "message")
    diag = diag.unionByName(missing_sheets(per_job, ujobs))
    lines = extract(rows, hc, roles, keys, written=True)
    for n in needed:
        lines = lines.where(F.col(f"{n}_pos").isNotNull())
    ok_jobs = hc.select(*JOB_KEYS, *[roles[n].alias(f"_{n}") for n in needed])
    for n in needed:
        ok_jobs = ok_jobs.where(F.col(f"_{n}").isNotNull())
    ok_jobs = ok_jobs.select(*JOB_KEYS).distinct()
    if r.date_order == "auto":
        lines = parse_dates_auto(lines, keys, "date")
    elif r.date_order == "serial_dmy":
        lines = coerce_dates(lines, keys, "date")
    elif r.date_order == "mdy":
        lines = lines.withColumn("mov_date", parse_monthfirst("date"))
    else:
        lines = lines.withColumn("mov_date", parse_dayfirst("date"))
    has_date = F.col("date_pos").isNotNull()
    number = coerce_number(F.regexp_replace(F.regexp_replace("qty", r"[\x{A0} ]", ""), ",", ".")
                           if r.stock_null_qty == "zero_locale" else "qty")
    diag = diag.unionByName(line_warnings(
        lines, ["atelier", "file_id", "sheet"], ref=normalize_ref("ref").isNull(), number=_bad("qty", number),
        date=has_date & _bad("date", F.col("mov_date"))))
    if r.date_order == "serial_dmy":
        lines = lines.where(F.col("mov_date").isNotNull())
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    qty = coerce_locale_number("qty") if r.stock_null_qty == "zero_locale" else qty_or_zero("qty")
    if r.mov_round is not None:
        qty = F.round(qty, r.mov_round)
    # read by the filters and joins that follow: stripped and parsed once a row
    cells = {"ref": strip_text("ref"), "qty": qty.cast(QTY)}
    if "loc" in roles:
        cells["loc"] = strip_text("loc")
    if r.period in ("cumulative", "exact_month"):
        cells["mov_date"] = F.col("mov_date")
    lines = computed(lines, **cells)
    if r.period == "cumulative":
        lines = lines.where(~has_date | (F.col("mov_date") < F.add_months(start, 1)))
    elif r.period == "exact_month":
        d = F.col("mov_date")
        lines = lines.where(~has_date | ((d >= start) & (d < F.add_months(start, 1))))
    loc = F.col("loc") if "loc" in roles else F.lit(None).cast("string")
    typed = lines.select(*JOB_KEYS, ref_key(F.col("ref")).alias("ref"), "qty", "mov_date",
                         loc.alias("localisation"), F.col("loc_pos").isNotNull().alias("_has_loc")
                         if "loc" in roles else F.lit(False).alias("_has_loc"))
    return typed, diag, ok_jobs


# --- snapshot side ----------------------------------------------------------------

def snapshot_lines(stock_grid: DataFrame, jobs: DataFrame, r: UnitRules):
    """Snapshot lines ``(unit, [atelier, job_idx,] ref, qty, local,
    localisation, source_sheet)`` under the unit's sheet / header / column
    rules, their diagnostics, and the keys (unit, or job) whose snapshot lacks
    a column.  With 'listed' sheets the lines are already per job."""
    g = stock_grid.where(F.col("unit") == r.unit) if "unit" in stock_grid.columns else \
        stock_grid.withColumn("unit", F.lit(r.unit))
    sheets = checked_broadcast(sheets_of(g), "sheet-list")
    kind, _, arg = r.stock_sheet.partition(":")
    per_job = kind == "listed"
    if per_job:
        js = (jobs.where(F.col("unit") == r.unit)
              .select(*JOB_KEYS, F.explode("stock_sheets").alias("sheet"), "stock_qty_col"))
        chosen = sheets.join(js, "sheet").select("file_id", "sheet", *JOB_KEYS, "stock_qty_col")
    elif kind == "candidates":
        fj = sheets.select("file_id").distinct().select(
            F.lit(r.unit).alias("unit"), "file_id", F.array(*[F.lit(c) for c in arg.split(",")]).alias("candidates"))
        chosen = sheet_from_candidates(sheets, fj, ["unit"]).where(F.col("sheet").isNotNull())
    else:
        chosen = sheet_by_keywords(sheets, arg.split(","), exact=(kind == "exact")).select(
            "file_id", "sheet", F.lit(r.unit).alias("unit"))
    keys = [*G_KEYS, *JOB_KEYS] if per_job else [*G_KEYS, "unit"]
    chosen = checked_broadcast(chosen, "sheets")
    rows = g.drop("unit").join(chosen, G_KEYS)
    hc = _headers(rows, r.stock_header, r, "stock", keys)
    if per_job:
        hc = hc.join(chosen.select(*keys, "stock_qty_col"), keys)
    hc = checked_broadcast(hc, "snapshot-headers")
    al = {k: aliases(r.unit, "stock", k) for k in ("ref", "quantity", "localisation", "local")}
    qty_pos = _stock_resolver(r, "quantity", al["quantity"])
    if per_job:
        qty_pos = F.when(F.col("stock_qty_col").isNotNull(),
                         C.resolve_custom_col("header", F.col("stock_qty_col"))).otherwise(qty_pos)
    roles = {"ref": _stock_resolver(r, "ref", al["ref"]), "qty": qty_pos}
    if al["localisation"]:
        roles["loc"] = _resolver(r.stock_resolve, al["localisation"])
    if al["local"]:
        roles["local"] = _resolver(r.stock_resolve, al["local"])
    needed = ["ref", "qty"] + (["loc"] if "loc" in roles and r.location_rule in ("stock_in", "in_not_in") else []) + (
        ["local"] if "local" in roles and r.location_rule == "local_or_pairs" else [])
    out = [c for c in keys if c not in G_KEYS]
    at = ["atelier", "file_id", "sheet"] if per_job else G_KEYS
    diag = missing_columns(hc, roles, needed, keys).select(
        "unit", F.concat_ws("/", *at).alias("scope"), "severity", "code", "message")
    bad = hc.select(*out, *[roles[n].alias(f"_{n}") for n in needed]).where(
        F.greatest(*[F.col(f"_{n}").isNull() for n in needed])).select(*out).distinct()
    lines = extract(rows, hc, roles, keys, written=True).where(F.col("ref_pos").isNotNull() & F.col("qty_pos").isNotNull())
    number = coerce_number(F.regexp_replace(F.regexp_replace("qty", r"[\x{A0} ]", ""), ",", ".")
                           if r.stock_null_qty == "zero_locale" else "qty")
    diag = diag.unionByName(line_warnings(lines, at, ref=normalize_ref("ref").isNull(), number=_bad("qty", number)))
    qty = coerce_locale_number("qty") if r.stock_null_qty == "zero_locale" else qty_or_zero("qty")
    if r.stock_round is not None:
        qty = F.round(qty, r.stock_round)
    # read by the filters and joins that follow: stripped and parsed once a row
    texts = [k for k in ("ref", "local", "loc") if k in roles]
    lines = computed(lines, qty=qty.cast(QTY), **{k: strip_text(k) for k in texts})
    typed = lines.select(*out, ref_key(F.col("ref")).alias("ref"), "qty",
                        (F.col("local") if "local" in roles else F.lit(None).cast("string")).alias("local"),
                        (F.col("loc") if "loc" in roles else F.lit(None).cast("string")).alias("localisation"),
                        F.col("sheet").alias("source_sheet"))
    return typed, diag, bad


def _explode_list(jobs: DataFrame, col: str, name: str) -> DataFrame:
    return jobs.select(*JOB_KEYS, F.explode(F.transform(col, lambda x: strip_text(x))).alias(name)).where(
        F.col(name) != "")


def _job_keys(jobs: DataFrame, unit: str, where: Column | None = None) -> list[tuple[str, int]]:
    """(atelier, job_idx) of a unit's jobs - configuration rows (a few per
    unit), read on the driver to tag lines without a join."""
    j = jobs.where(F.col("unit") == unit)
    if where is not None:
        j = j.where(where)
    return sorted({(r.atelier, r.job_idx) for r in j.select("atelier", "job_idx").collect()})


def _tag_jobs(df: DataFrame, unit: str, keys: list[tuple[str, int]]) -> DataFrame:
    """Every row once per listed job of ``unit`` (no join: the job list is a
    literal array)."""
    if not keys:
        return df.where(F.lit(False)).select(F.lit(unit).alias("unit"), F.lit(None).cast("string").alias("atelier"),
                                             F.lit(None).cast("int").alias("job_idx"), "*")
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i")) for a, i in keys])
    t = df.select("*", F.explode(arr).alias("_job"))
    return t.select(F.lit(unit).alias("unit"), F.col("_job.a").alias("atelier"),
                    F.col("_job.i").cast("int").alias("job_idx"), *[c for c in df.columns if c != "unit"])


def apply_locations(stock: DataFrame, mov: DataFrame, jobs: DataFrame, r: UnitRules):
    """Per-job location rules -> (stock lines by job, ledger lines by job)."""
    ujobs = F.broadcast(jobs.where(F.col("unit") == r.unit))
    if r.stock_sheet == "listed":                       # the job's own sheets already
        return stock, mov
    if r.location_rule == "none":
        return _tag_jobs(stock, r.unit, _job_keys(jobs, r.unit)).select(*JOB_KEYS, "ref", "qty"), mov
    if r.location_rule == "local_or_pairs":
        plain = _explode_list(ujobs, "locations", "_l")
        pairs = ujobs.select(*JOB_KEYS, F.explode("location_pairs").alias("_p"))
        s1 = stock.join(plain, (stock["unit"] == plain["unit"]) & (stock["local"] == plain["_l"])).select(
            *[plain[k] for k in JOB_KEYS], "ref", "qty")
        s2 = stock.join(pairs, (stock["unit"] == pairs["unit"]) & (stock["local"] == strip_text("_p.local"))
                        & (stock["localisation"] == strip_text("_p.localisation"))).select(
            *[pairs[k] for k in JOB_KEYS], "ref", "qty")
        return s1.unionByName(s2), mov
    if r.location_rule == "in_not_in":
        conf = _explode_list(ujobs.where(F.size("locations") > 0), "locations", "_l")
        implicit_jobs = _job_keys(jobs, r.unit, F.coalesce(F.size("locations"), F.lit(0)) <= 0)
        implicit = _tag_jobs(stock.select(F.col("localisation").alias("_l")).where(F.col("_l") != "").distinct(),
                             r.unit, implicit_jobs)
        inc = conf.unionByName(implicit.select(*JOB_KEYS, "_l"))
        exc = _explode_list(ujobs.where(F.size("exclude") > 0), "exclude", "_x")
        inc = inc.join(exc, [inc[k] == exc[k] for k in JOB_KEYS] + [inc["_l"] == exc["_x"]], "left_anti")
        # one row per (job, location), partly derived from the data: joined to
        # both sides by its checked size
        inc = checked_broadcast(inc, "locations")
        s = stock.join(inc, (stock["unit"] == inc["unit"]) & (stock["localisation"] == inc["_l"])).select(
            *[inc[k] for k in JOB_KEYS], "ref", "qty")
        nl = ujobs.select(*JOB_KEYS, "no_loc_col")
        m = mov.join(nl, JOB_KEYS)
        with_loc = m.where(~F.col("no_loc_col"))
        with_loc = with_loc.where(F.col("localisation").isNotNull() & (F.col("localisation") != ""))
        with_loc = with_loc.join(exc, [with_loc[k] == exc[k] for k in JOB_KEYS]
                                 + [with_loc["localisation"] == exc["_x"]], "left_anti")
        with_loc = with_loc.join(inc, [with_loc[k] == inc[k] for k in JOB_KEYS]
                                 + [with_loc["localisation"] == inc["_l"]], "left_semi")
        m = with_loc.unionByName(m.where(F.col("no_loc_col"))).drop("no_loc_col")
        return s, m
    # stock_in (an empty list keeps everything)
    inc = _explode_list(ujobs, "locations", "_l")
    s = stock.join(inc, (stock["unit"] == inc["unit"]) & (stock["localisation"] == inc["_l"])).select(
        *[inc[k] for k in JOB_KEYS], "ref", "qty")
    keep_all = _job_keys(jobs, r.unit, F.coalesce(F.size("locations"), F.lit(0)) <= 0)
    if not keep_all:
        return s, mov
    s_all = _tag_jobs(stock, r.unit, keep_all).select(*JOB_KEYS, "ref", "qty")
    return s.unionByName(s_all), mov


def run_units(stock_grid: DataFrame, mov_grid: DataFrame, jobs: DataFrame, rules: list[UnitRules],
              year: int, month: int, opening_grid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All units and jobs in one plan.

    ``jobs`` - job rows (``plans.sites.JOB_DDL``) plus the assigned ledger
    ``file_id``; ``stock_grid`` / ``opening_grid`` - snapshot grids with a
    ``unit`` column (or shared by all units).  Returns ``(recon, diagnostics)``.
    """
    from ledgerlens.session import stage, stage_by
    # every unit reads its grids several times: stage them once, a folder per
    # unit, so that a unit's passes scan its own files and no others
    unit_files = checked_broadcast(jobs.select("unit", "file_id").distinct(), "unit-files")
    mov_grid = stage_by(mov_grid.drop("unit").join(unit_files, "file_id"), "unit", "grid-ledger")
    stock_grid, opening_grid = [
        g if g is None else stage_by(g, "unit", "grid-stock") if "unit" in g.columns else stage(g, "grid-stock")
        for g in (stock_grid, opening_grid)]

    def of_unit(r: UnitRules) -> tuple[DataFrame, DataFrame]:
        mov, diag, ok_jobs = movement_lines(mov_grid.where(F.col("unit") == r.unit).drop("unit"), jobs, r, year, month)
        lines, stock_diag, bad = snapshot_lines(stock_grid, jobs, r)
        diag = diag.unionByName(stock_diag)
        stock, mov = apply_locations(lines, mov, jobs, r)
        # only jobs whose ledger and snapshot could be read produce results;
        # job lists are configuration-sized
        ok_jobs = ok_jobs.join(F.broadcast(bad), bad.columns, "left_anti")
        mov = mov.join(F.broadcast(ok_jobs), JOB_KEYS, "left_semi")
        stock = stock.join(F.broadcast(ok_jobs), JOB_KEYS, "left_semi")
        if r.period == "exact_month" and opening_grid is not None:
            lines, opening_diag, _ = snapshot_lines(opening_grid, jobs, r)
            diag = diag.unionByName(opening_diag)
            opening, _ = apply_locations(lines, mov, jobs, r)
            opening = opening.join(F.broadcast(ok_jobs), JOB_KEYS, "left_semi")
            return rollforward(stock, mov, opening, keys=tuple(JOB_KEYS), mov_round=r.mov_round, tolerance=r.tolerance), diag
        return R.reconcile(stock, mov, JOB_KEYS, tolerance=r.tolerance if r.match == "tolerance" else None), diag

    # units share no table: their small per-sheet jobs run side by side
    with ThreadPoolExecutor(max_workers=4) as pool:
        done = list(pool.map(of_unit, rules))
    recon, diag = done[0]
    for x, d in done[1:]:
        recon, diag = recon.unionByName(x), diag.unionByName(d)
    return recon, diag


def assign_jobs(job_rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Attach the ledger file assigned to each atelier (``match_files``)."""
    return job_rows.join(assigned.select("unit", "atelier", F.col("path").alias("file_id")), ["unit", "atelier"])


def demo_inputs(spark: SparkSession, sf_dir: str):
    """Profiles applied to the lineitem workbooks: unit Fath1 reads the 'F'
    ledgers, unit Mdoukal the 'O' ledgers; atelier = return flag, whose
    snapshot location is the same letter."""
    from ledgerlens.plans.sites import JOB_DDL
    from ledgerlens.sources.grids import ledger_grid, stock_grid
    mov_grid = ledger_grid(spark, sf_dir)
    sgrid = stock_grid(spark, sf_dir)
    rows = [(u, a, 0, a, ["MOUVEMENT", "MOV"], False, None, None, [a], None, None, None, None, None, False,
             f"MOV {a}{s}.xlsx") for u, s in (("Fath1", "F"), ("Mdoukal", "O")) for a in "ANR"]
    jobs = spark.createDataFrame(rows, JOB_DDL + ", file_id string")
    # the rendered snapshot workbook has a junk first sheet and no date column,
    # so the second unit reads it with the preference / densest-row rules
    rules = [UnitRules.from_profile("Fath1"),
             UnitRules.from_profile("Mdoukal", date_order="dmy", stock_sheet="prefer:STOCK", stock_header="densest")]
    return sgrid, mov_grid, jobs, rules
