"""Assign ledger files to ateliers by keyword.

Candidates (file, atelier) come from a join of the file listing with the
atelier keyword table on the unit and a substring predicate.
Two greedy policies exist:

* ``files_first``   - files in order; each takes its first *free* matching
  atelier.
* ``ateliers_first`` - ateliers in order; each takes its first unused
  matching file, where a file matches when it contains the trimmed keyword or
  every whitespace-separated word of it.

A sequential greedy choice has no single relational step, so each unit's
candidate list is resolved by ``applyInPandas`` grouped by unit, many units in
parallel.  A unit with A ateliers assigns at most A files, so of each
atelier's candidates only the first A in file order can matter (were all of
them taken by others, more than A files would be assigned): the rest is cut
before the grouping and no group exceeds A x A rows however many files a unit
has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

ASSIGN_SCHEMA = "unit string, atelier string, path string"


def candidates(files: DataFrame, ateliers: DataFrame, mode: str = "files_first") -> DataFrame:
    """files(unit, path, file_name, file_pos), ateliers(unit, atelier, keyword, atelier_pos)."""
    name, kw = F.col("f._name"), F.col("a._kw")
    if mode == "files_first":
        a = ateliers.withColumn("_kw", F.lower("keyword"))
        pred = name.contains(kw)
    else:
        a = ateliers.withColumn("_kw", F.lower(F.trim("keyword")))
        a = a.withColumn("_words", F.split("_kw", r"\s+"))
        pred = name.contains(kw) | F.forall("a._words", lambda w: name.contains(w))
    # texts are made ready once per row (written, or they move into the join and are made per pair)
    f = cut_lineage(files.withColumn("_name", F.lower("file_name")), "match-files").alias("f")
    a = cut_lineage(a, "match-ateliers").alias("a")
    return (f.join(a, (F.col("f.unit") == F.col("a.unit")) & pred)
            .select("f.unit", "f.path", "f.file_pos", "a.atelier", "a.atelier_pos"))


def _greedy(mode: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if mode == "files_first":
            taken = set()
            for _, grp in pdf.sort_values(["file_pos", "atelier_pos"]).groupby("file_pos", sort=True):
                for row in grp.itertuples():
                    if row.atelier not in taken:
                        taken.add(row.atelier)
                        out.append((row.unit, row.atelier, row.path))
                        break
        else:
            used = set()
            for _, grp in pdf.sort_values(["atelier_pos", "file_pos"]).groupby("atelier_pos", sort=True):
                for row in grp.itertuples():
                    if row.path not in used:
                        used.add(row.path)
                        out.append((row.unit, row.atelier, row.path))
                        break
        return pd.DataFrame(out, columns=["unit", "atelier", "path"])
    return run


def assign(files: DataFrame, ateliers: DataFrame, mode: str = "files_first") -> DataFrame:
    """(unit, atelier, path) of the greedy assignment."""
    from ledgerlens.session import ship_package
    ship_package(files.sparkSession)
    sizes = ateliers.groupBy("unit").agg(F.count(F.lit(1)).alias("_a"))
    order = Window.partitionBy("unit", "atelier").orderBy("file_pos", "path")
    cand = (candidates(files, ateliers, mode).join(sizes, "unit").withColumn("_turn", F.row_number().over(order))
            .where(F.col("_turn") <= F.col("_a")).drop("_turn", "_a"))
    return cand.groupBy("unit").applyInPandas(_greedy(mode), ASSIGN_SCHEMA)


def unmatched(files: DataFrame, ateliers: DataFrame, assigned: DataFrame) -> DataFrame:
    """Files left without an atelier and ateliers left without a file."""
    assigned = cut_lineage(assigned, "assigned")  # read twice
    uf = (files.join(assigned.select("unit", "path"), ["unit", "path"], "left_anti")
          .select("unit", F.lit("file").alias("kind"), F.col("file_name").alias("name")))
    ua = (ateliers.join(assigned.select("unit", "atelier"), ["unit", "atelier"], "left_anti")
          .select("unit", F.lit("atelier").alias("kind"), F.col("atelier").alias("name")))
    return uf.unionByName(ua)


def match_counts(files: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per unit: files given and files matched."""
    n_files = files.groupBy("unit").agg(F.count(F.lit(1)).alias("n_files"))
    n_matched = assigned.groupBy("unit").agg(F.count(F.lit(1)).alias("n_matched"))
    return n_files.join(n_matched, "unit", "left").fillna(0, ["n_matched"])
