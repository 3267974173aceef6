"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, first) of line keys and the smallest document that
holds them, hash-bucketed and sorted by key.  Documents arrive in batches of
ascending doc_id.  A batch aggregates its own keys, merge-anti-joins the runs
(bucketed and sorted alike, one file a bucket, so only the new keys are
shuffled and sorted) and adds what is new as a run of level 0.  When a level
holds ``FANOUT`` runs they are merged, bucket by bucket in key order, into one
run of the next level.  The runs together hold every key once, with the
smallest doc_id: a line stays where that is its own document.  Runs are
catalog tables only as long as they are needed; ``close`` drops the last ones
and leaves their files to the shared scratch folder.

Keys are 96 bits of hash.  Defined results: null or empty text is one empty
line; lines whose key has fewer than ``MIN_CHARS`` code points stay; a null
doc_id counts as the largest; rows that repeat a doc_id are one document;
extra columns pass through untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import identity, lines_of, lower_ascii, partitions, save, strip_ascii, without_lines
from ledgerlens.session import scratch_path

MIN_CHARS, BATCHES, FANOUT = 10, 4, 2


#: Lets a scan of a bucketed table with one file a bucket keep its sort order.
KEEP_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The runs, by level: a run is the name of a table."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.paths = spark, fanout, [], {}
        self.buckets = partitions(spark)

    def _run(self, keys: DataFrame) -> str:
        """Write keys that are dealt by bucket, so that a bucket is one file."""
        name = f"llm_line_run_{uuid.uuid4().hex[:12]}"
        self.paths[name] = scratch_path(self.spark, name)
        keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _in_order(self, make) -> str:
        """``make()`` written as a run, the runs it reads scanned in their order."""
        before = self.spark.conf.get(KEEP_ORDER)
        self.spark.conf.set(KEEP_ORDER, "true")
        try:
            return self._run(make())
        finally:
            self.spark.conf.set(KEEP_ORDER, before)

    def without_known(self, lines: DataFrame) -> DataFrame:
        """The keys of lines (doc, h1, h2) that no run holds, with their first doc."""
        new = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
        for level in self.levels:
            for run in level:
                new = new.join(self.spark.table(run).hint("merge"), ["h1", "h2"], "left_anti")
        return new

    def merged(self, runs: list[str]) -> DataFrame:
        """Runs, which share no key, as one: a merge join by key from sorted
        buckets, so that a bucket stays one partition."""
        out = self.spark.table(runs[0])
        for r in runs[1:]:
            out = out.hint("merge").join(self.spark.table(r).withColumnRenamed("first", "other"), ["h1", "h2"], "full").select(
                "h1", "h2", F.coalesce("first", "other").alias("first"))
        return out

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (doc, h1, h2); no doc may be smaller than one
        of an earlier batch."""
        self._place(self._in_order(lambda: self.without_known(lines)), 0)

    def _place(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._in_order(lambda: self.merged(old)), level + 1)
            self._drop(old)

    def _drop(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")

    def close(self) -> DataFrame:
        """Every key once, with the smallest doc that holds it, read from the
        files of the runs; the tables go."""
        runs = [r for level in self.levels for r in level]
        schema = self.spark.table(runs[0]).schema
        self._drop(runs)
        return self.spark.read.schema(schema).parquet(*[self.paths[r] for r in runs])


def line_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc, tx, pos, h1, h2) of the lines with a key long enough."""
    exploded = rows.select("doc", "tx", F.posexplode(lines_of(F.col("d.text"))).alias("pos", "line"))
    key = exploded.select("doc", "tx", "pos", lower_ascii(strip_ascii(F.col("line"))).alias("key"))
    return key.where(F.length("key") >= min_chars).select(
        "doc", "tx", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(d, text, n_lines, n_dropped): each row of ``docs`` as a struct, its
    text without the lines that a smaller document holds."""
    rows = identity(docs)
    # borders of the batches: a handful of doc_ids
    at = [i / batches for i in range(1, batches)]
    borders = sorted(set(rows.agg(F.percentile_approx("doc", at, 1000)).first()[0] or [])) if at else []
    batch = sum([F.when(F.col("doc") > b, 1).otherwise(0) for b in borders], F.lit(0))
    lines = save(line_keys(rows, min_chars).withColumn("batch", batch), "lines")
    runs = LineRuns(docs.sparkSession)
    for i in range(len(borders) + 1):
        runs.add(lines.where(F.col("batch") == i))
    first = runs.close().withColumnRenamed("first", "doc")
    # the key and the document together are the join key: a line that stands
    # in a third of all documents is spread over as many keys
    dropped = (lines.join(first, ["h1", "h2", "doc"], "left_anti")
               .groupBy("doc", "tx").agg(F.collect_set("pos").alias("gone")))
    found = (rows.join(dropped, [rows.doc == dropped.doc, rows.tx.eqNullSafe(dropped.tx)], "left")
             .select("d", "gone"))
    return without_lines(found).select(
        "d", "n_lines", F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), "text")
