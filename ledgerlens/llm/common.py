"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

#: ASCII whitespace of the word rule (words are ``[^\x20\x09-\x0D]+``).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"


def ship(module_name: str) -> None:
    """Send the functions of a module to Python workers by value, so that no
    worker has to import this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def save(df: DataFrame, name: str, share: int = 1) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and read it back.
    ``share``: for a table that is a small part of the data, one file for so
    many shuffle partitions (8 files at least)."""
    if share > 1:
        df = df.coalesce(max(8, partitions(df.sparkSession) // share))
    return cut_lineage(df, f"llm-{name}")


#: Stands for a null doc_id, which counts as the largest.
LAST = 2**63 - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Array of the words of a text; null or blank text: empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAPS, -1))


def lines_of(text: Column) -> Column:
    """Array of the newline-separated lines; null or empty text: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def identity(docs: DataFrame) -> DataFrame:
    """``docs`` as (d: the whole row, doc: its doc_id or LAST, tx: hash of its
    text).  (doc, tx) names a row by content: rows that share it are alike, so
    every result computed for one holds for the others.  Keeping the row in a
    struct leaves no column that could clash."""
    return docs.select(F.struct("*").alias("d"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64(F.col("text")).alias("tx"))


def without_lines(df: DataFrame) -> DataFrame:
    """``df`` (d, gone, ...) with n_lines and ``text``: the text of d without
    the lines at the places ``gone`` (null: none), joined by newlines.  The
    lines are a column of their own first: inside a lambda they would be
    split again for every element."""
    split = df.withColumn("lines", lines_of(F.col("d.text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return split.select(
        *df.columns, F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.coalesce("d.text", F.lit("")))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("text"))


def with_text(row: str, text: Column, columns: list[str]) -> list[Column]:
    """The columns of a kept row struct with its text replaced, and n_chars
    following the text where the table has it."""
    out = []
    for c in columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.length(text).cast("long").alias(c))
        else:
            out.append(F.col(f"{row}.`{c}`").alias(c))
    return out


def contracted(edges: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Edges (u, v) of binary node keys, each task's chunk of them replaced by
    links to the smallest node of its local component."""

    def run(batches):
        import pyarrow as pa

        def flush(up):
            def top(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x
            links = [(x, top(x)) for x in list(up)]
            links = [(x, r) for x, r in links if x != r]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([r for _, r in links], pa.binary())], ["u", "v"])

        up: dict = {}
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n in (x, y):
                    up.setdefault(n, n)
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                while up[y] != y:
                    up[y] = up[up[y]]
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= chunk:
                yield flush(up)
                up = {}
        if up:
            yield flush(up)

    return edges.mapInArrow(run, "u binary, v binary")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` over binary node keys: (node,
    comp), comp the smallest node of its component.

    Every task first contracts its own edges; then large-star and small-star
    steps alternate (O(log n) rounds for chains) until the edges are stars.
    Each round is one written table, so a lost executor costs one round.
    Nothing but a yes or no reaches the driver.
    """
    e = save(contracted(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")), "edges", 8)
    for _ in range(max_rounds):
        hubs = e.select(F.col("v").alias("hub")).distinct()
        chains = e.join(hubs, e.u == hubs.hub, "left_semi").select("u")
        forks = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        if chains.union(forks).isEmpty():
            break
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))))
        e = save(contracted(small.where("u <> v").distinct()), "stars", 8)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


ship(__name__)
