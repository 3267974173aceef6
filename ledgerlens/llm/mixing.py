"""Mixing sources to target weights by hash-threshold histograms.

A document's hash decides: of a source whose target is t words out of s, every
document is taken floor(t / s) times, and once more where its hash lies below
the source's threshold.  The threshold is found without sorting documents:
words are summed by source and hash bucket (``BITS`` bits), the bucket in
which the running sum crosses the budget is the boundary, everything below it
is in, and only the documents of the boundary bucket are summed again by the
next ``BITS`` bits, until the boundary holds one hash.  That last hash is
taken if this comes nearer to the budget.  Budgets of one source are nested:
what a smaller budget takes, a larger one takes too.

Defined results: null text has size 0; a null source is the last source; rows
that repeat a doc_id share a hash and are taken together; a source without
words has target 0; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import save, words_of
from ledgerlens.operators.ordering import rank_within
from ledgerlens.session import checked_broadcast

HASH_BITS, BITS = 60, 12


def doc_hash(doc_id: Column, seed: int = 0) -> Column:
    """60 bits of the md5 of seed and doc_id, as long."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """The source as a string that sorts by code point with null last."""
    s = source.cast("string")
    return F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s))


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(k, source_size) with a weight: ``weights`` in turn, by source order."""
    ranked = rank_within(sources, [], [F.col("k").asc()])
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    return ranked.select("k", "source_size", pick.alias("weight"))


def targets(sources: DataFrame, total: float, max_repeat: float) -> DataFrame:
    """``sources`` (k, source_size, weight) with the target of each: shares of
    ``total`` times all words by weight, at most ``max_repeat`` times the
    source; what is over goes to the others by weight.  The loop moves two
    sums and a count per pass to the driver."""
    s = save(sources.withColumn("cap", max_repeat * F.col("source_size")), "sources")
    first = s.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    budget, weight = total * (first.n or 0), first.w or 0.0
    level, capped = (budget / weight if weight else 0.0), 0
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("cap"),
                  F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum(over.cast("long")).alias("n")).first()
        if not r.n or r.n == capped or not r.w:
            break
        level, capped = (budget - r.cap) / r.w, r.n
    return s.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def thresholds(base: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` (k, source_size, target) with ``copies``, what every document
    of the source is taken, and ``bound``: those with a hash below it are
    taken once more.  ``base``: (k, size, h)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    g = goals.withColumn("copies", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("copies") * F.col("source_size"))
    g = save(g, "goals")
    open_ = g.where("rest > 0").select("k", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    settled = None
    order = Window.partitionBy("k").orderBy("bucket")
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        bucket = F.shiftright("h", shift)
        rows = base.select("k", "size", "h", bucket.alias("bucket"), F.shiftright(bucket, BITS).alias("prefix"))
        hist = (rows.join(open_.select("k", "prefix"), ["k", "prefix"]).groupBy("k", "bucket")
                .agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most")))
        # at most 2**BITS rows a source
        run = (hist.withColumn("upto", F.sum("words").over(order)).join(open_.select("k", "rest", "under"), "k")
               .withColumn("upto", F.col("upto") + F.col("under")).where(F.col("upto") >= F.col("rest")))
        edge = run.groupBy("k").agg(F.min_by(F.struct("bucket", "words", "least", "most", "upto", "rest"), "bucket").alias("e")).select("k", "e.*")
        edge = save(edge.withColumn("under", F.col("upto") - F.col("words")), "boundary")
        done = edge.where("least = most").select(
            "k", F.when(F.col("rest") - F.col("under") <= F.col("upto") - F.col("rest"), F.col("least"))
            .otherwise(F.col("least") + 1).alias("bound"))
        settled = done if settled is None else settled.union(done)
        open_ = edge.where("least < most").select("k", "rest", F.col("bucket").alias("prefix"), "under")
        if open_.isEmpty():
            break
    return g.join(settled, "k", "left").select("k", "source_size", "target", "copies",
                                               F.coalesce("bound", F.lit(0)).alias("bound"))


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, k, size, h) of every row."""
    return docs.select("doc_id", source_key(F.col("source")).alias("k"), F.size(words_of(F.col("text"))).cast("long").alias("size"),
                       doc_hash(F.col("doc_id"), seed).alias("h"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, max_repeat: float = 2.0,
             seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(base, bounds): the documents as ``sized`` and one row per source with
    its target and threshold."""
    base = save(sized(docs, seed), "sized")
    sources = base.groupBy("k").agg(F.sum("size").alias("source_size"))
    goals = targets(cyclic_weights(sources, weights), total, max_repeat)
    return base, checked_broadcast(thresholds(base, goals), "mix-bounds")


def times() -> Column:
    """How often a document with its source's threshold is taken."""
    return F.col("copies") + (F.col("h") < F.col("bound")).cast("long")


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    base, bounds = plan_mix(docs, **options)
    return base.join(bounds, "k").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mix(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mix: every row of ``docs`` as often as it is taken."""
    _, bounds = plan_mix(docs, seed=seed, **options)
    rows = docs.select(F.struct("*").alias("d")).select(
        "d", source_key(F.col("d.source")).alias("k"), doc_hash(F.col("d.doc_id"), seed).alias("h"))
    return (rows.join(bounds, "k").withColumn("n", times().cast("int")).where("n > 0")
            .select("d", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).select("d.*"))
