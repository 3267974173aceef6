"""The whole reconciliation request, as one Spark plan.

``process`` takes a table of input files - ``inputs(unit, role, path)``
with role 'stock', 'opening' or 'ledger', in the order given (or by an
optional ``pos`` column) - and a target period, and does
what a user of the desktop flow does by hand: read every file as a grid,
match ledger files to ateliers by keyword, drop skipped ateliers, apply
sheet / column overrides, run every unit's rules and return the results with
their diagnostics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import matching as M
from ledgerlens.operators.ordering import positioned
from ledgerlens.plans.pipeline import UnitRules, run_units
from ledgerlens.plans.profiles import ledger_names, profile_frame
from ledgerlens.plans.sites import SITES, jobs_frame
from ledgerlens.operators.verify import missing_inputs, unknown_ateliers, verification
from ledgerlens.session import checked_broadcast, cut_lineage
from ledgerlens.sources.grid_reader import noted, read_files, readable, unreadable
from ledgerlens.sources.grids import GRID_SCHEMA
from ledgerlens.sources.xlsx import local_path


def atelier_keywords(spark: SparkSession, units) -> DataFrame:
    """(unit, atelier, keyword, atelier_pos) from the site configuration."""
    rows = [(u, a, str(cfg.get("keyword", a)), i) for u in units for i, (a, cfg) in enumerate(SITES[u].items())]
    return spark.createDataFrame(rows, "unit string, atelier string, keyword string, atelier_pos int")


def _basename(c):
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def process(spark: SparkSession, inputs: DataFrame, year: int, month: int,
            skip: DataFrame | None = None, overrides: DataFrame | None = None,
            match_mode: str = "ateliers_first", rules: dict[str, UnitRules] | None = None):
    """Returns ``(recon, diagnostics, assigned)``; ``recon`` carries the
    ``position`` of every row in its list, by its unit's order.

    ``skip(unit, atelier)`` - ateliers left out of the run;
    ``overrides(unit, atelier, sheet_name, ref_col, qty_col)`` - user
    choices (blank = keep the configured value).  The file listing and the
    configuration are small tables; every data-sized step is distributed.
    """
    # files are known by their full path; the order they were given in counts
    if "pos" not in inputs.columns:
        inputs = inputs.withColumn("pos", F.monotonically_increasing_id())
    inputs = cut_lineage(inputs.withColumn("path", local_path(F.col("path")))
                         .withColumn("file_name", _basename(F.col("path"))), "inputs")
    units = [u for u in SITES]
    if rules is None:
        # the rule matrix: a row per unit, configuration
        rules = {r.unit: UnitRules(**r.asDict()) for r in profile_frame(spark).collect()}
    ledgers = inputs.where(F.col("role") == "ledger")
    ledgers = ledgers.withColumn("file_pos", F.col("pos"))
    ateliers = atelier_keywords(spark, units)
    if skip is not None:
        ateliers = ateliers.join(F.broadcast(skip.select("unit", "atelier")), ["unit", "atelier"], "left_anti")
    assigned = M.assign(ledgers.select("unit", "path", "file_name", "file_pos"), ateliers, match_mode)
    jobs = jobs_frame(spark).join(assigned.select("unit", "atelier", F.col("path").alias("file_id")),
                                  ["unit", "atelier"])
    if overrides is not None:
        o = overrides.select("unit", "atelier", "sheet_name", F.col("ref_col").alias("_ref"),
                             F.col("qty_col").alias("_qty"))
        jobs = jobs.join(F.broadcast(o), ["unit", "atelier"], "left")
        blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
        jobs = (jobs.withColumn("candidates", F.when(blank("sheet_name").isNotNull(), F.array(blank("sheet_name")))
                                .otherwise(F.col("candidates")))
                .withColumn("ref_col", F.coalesce(blank("_ref"), F.col("ref_col")))
                .withColumn("qty_col", F.coalesce(blank("_qty"), F.col("qty_col")))
                .drop("sheet_name", "_ref", "_qty"))
    # Spark lists its input files on the driver: the paths go there once
    paths = [r.path for r in inputs.select("path").distinct().toLocalIterator()]
    everything = cut_lineage(read_files(spark, paths), "grid-files") if paths else spark.createDataFrame([], GRID_SCHEMA)
    files_unit = checked_broadcast(inputs.select("unit", "role", F.col("path").alias("file_id")).distinct(), "files")

    whole = readable(everything)

    def grid_of(role):
        own = files_unit.where(F.col("role") == role).drop("role")
        return whole.join(own, "file_id")

    stock_grid, ledger_grid = grid_of("stock"), whole.join(
        files_unit.where(F.col("role") == "ledger").select("file_id").distinct(), "file_id", "left_semi")
    has_opening = not inputs.where(F.col("role") == "opening").isEmpty()
    opening_grid = grid_of("opening") if has_opening else None
    broken = unreadable(everything).join(files_unit, "file_id").select(
        "unit", F.col("file_id").alias("scope"), F.lit("error").alias("severity"), F.lit("UNREADABLE_FILE").alias("code"), "message")
    notes_of = noted(everything).join(files_unit, "file_id").select(
        "unit", F.col("file_id").alias("scope"), F.lit("warning").alias("severity"), F.lit("UNCLOSED_QUOTE").alias("code"), "message")
    lacking = missing_inputs(inputs, inputs.where(F.col("role") == "stock"), assigned).select(
        F.col("scope").alias("unit"), "scope", "severity", "code", "message")
    asked = [d.select("unit", "atelier") for d in (skip, overrides) if d is not None]
    notes = broken.unionByName(notes_of).unionByName(lacking).unionByName(_unmatched(ledgers, assigned))
    for a in asked:
        notes = notes.unionByName(unknown_ateliers(a, atelier_keywords(spark, units)).select(
            "unit", F.col("atelier").alias("scope"), "severity", "code", "message"))
    present = {r.unit for r in jobs.select("unit").distinct().toLocalIterator()}
    active = [rules[u] for u in units if u in present]
    if not active:
        empty = spark.createDataFrame([], "unit string, atelier string, job_idx int, Ref string, Stock_Qty double, "
                                          "Calc_Mov_Qty double, Difference double, status string, position long")
        return empty, notes, assigned
    recon, diag = run_units(stock_grid, ledger_grid, jobs, active, year, month, opening_grid)
    return positioned(recon, {r.unit: r.order for r in active}), diag.unionByName(notes), assigned


def verify(spark: SparkSession, inputs: DataFrame, match_mode: str = "ateliers_first") -> DataFrame:
    """Before a run: ``operators.verify.verification`` of every ledger file of
    ``inputs`` that an atelier's keyword matches, under the sheets and header
    names of its unit."""
    if "pos" not in inputs.columns:
        inputs = inputs.withColumn("pos", F.monotonically_increasing_id())
    ledgers = cut_lineage(inputs.where(F.col("role") == "ledger").withColumn("path", local_path(F.col("path"))).select(
        "unit", "path", _basename(F.col("path")).alias("file_name"), F.col("pos").alias("file_pos")), "inputs")
    assigned = M.assign(ledgers, atelier_keywords(spark, list(SITES)), match_mode)
    jobs = jobs_frame(spark).where("job_idx = 0").select("unit", "atelier", F.col("candidates").alias("expected_sheets")).join(
        assigned.select("unit", "atelier", F.col("path").alias("file_id")), ["unit", "atelier"])
    # Spark lists its input files on the driver: the paths go there once
    paths = [r.path for r in ledgers.select("path").distinct().toLocalIterator()]
    everything = cut_lineage(read_files(spark, paths), "grid-files") if paths else spark.createDataFrame([], GRID_SCHEMA)
    return verification(readable(everything), jobs, ledger_names(spark, list(SITES)), unreadable(everything))


def _unmatched(ledgers: DataFrame, assigned: DataFrame) -> DataFrame:
    left = ledgers.join(assigned.select("unit", "path"), ["unit", "path"], "left_anti")
    return left.select("unit", F.col("file_name").alias("scope"), F.lit("warning").alias("severity"),
                       F.lit("UNMATCHED_FILE").alias("code"),
                       F.lit("no atelier keyword found in the file name").alias("message"))
