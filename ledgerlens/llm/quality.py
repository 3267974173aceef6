"""Quality rules: per-document word rules and cross-document line frequency.

Lines are normalised (A-Z lower-cased, digit runs to 0, white space to one
blank), hashed, and counted once per distinct document of a host (the
``source`` column).  A line in more than ``max(MIN_DOCS, SHARE * documents of
the host)`` documents is boilerplate: it is removed everywhere but in the
smallest doc_id of the host that holds it, so one copy of a repeated text
stays whole.  A document that loses more than ``DEPLETED`` of its words
this way is rejected, as is one that fails the base rules.

Defined results: null text has no words (and fails the base rule); a null
source is a host of its own; a null doc_id counts as the largest; rows that
repeat a doc_id are one document when lines are counted; extra columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACES, identity, lines_of, lower_ascii, save, strip_ascii, words_of

MIN_DOCS, SHARE, DEPLETED = 20, 0.005, 0.7
GRAM, MIN_WORDS, MAX_REPEAT = 5, 10, 20
SYMBOLS = "#*$%&|<>"


def measures(rows: DataFrame) -> DataFrame:
    """(doc_id, doc, tx) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words.

    Every step refers to the arrays of the step before more than once, so the
    optimizer keeps them as columns instead of recomputing them per element.
    A filter on the results would be pushed through all steps and undo that:
    write them first.
    """
    ids = ["doc_id", "doc", "tx"]
    text = F.coalesce("d.text", F.lit(""))
    one = rows.select(
        F.col("d.doc_id").alias("doc_id"), "doc", "tx", words_of(text).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(lines_of(text), lambda x: strip_ascii(x) != "").alias("full"))
    two = one.select(
        *ids, "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    base = ["word_chars", "n_symbols", "n_words", "n_dup_lines"]
    gram = F.transform(F.slice("h", 1, F.greatest(F.size("h") - GRAM + 1, F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, GRAM)]))
    three = two.select(*ids, *base, gram.alias("g"))
    # (hash, place) sorted, only where some window repeats
    four = three.select(*ids, *base, F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))).alias("s"))
    twice = F.filter("s", lambda x, k: (x["g"] == F.get("s", k - 1)["g"]) | (x["g"] == F.get("s", k + 1)["g"]))
    five = four.select(*ids, *base, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("p"))
    cover = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get("p", k + 1) - x, F.lit(GRAM)))),
                        F.lit(0).cast("long"), lambda a, x: a + x)
    return five.select(*ids, *base, F.coalesce(F.when(F.size("p") > 0, cover), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): lines (doc, tx, host, pos, h, words), and the
    (host, h, first) above the limit of their host."""
    exploded = rows.select("doc", "tx", F.col("d.source").cast("string").alias("host"),
                           F.posexplode(lines_of(F.col("d.text"))).alias("pos", "line"))
    norm = F.regexp_replace(F.regexp_replace(lower_ascii(strip_ascii(F.col("line"))), "[0-9]+", "0"), "[\\x20\\x09-\\x0D]+", " ")
    lines = save(exploded.select("doc", "tx", "host", "pos", norm.alias("n"), F.size(words_of(F.col("line"))).alias("words"))
                 .where("words > 0").select("doc", "tx", F.coalesce("host", F.lit("\u0000")).alias("host"), "pos",
                                            F.xxhash64("n").alias("h"), "words"), "quality-lines")
    hosts = (rows.select(F.coalesce(F.col("d.source").cast("string"), F.lit("\u0000")).alias("host"), "doc")
             .groupBy("host").agg(F.countDistinct("doc").alias("host_docs")))
    counts = lines.groupBy("host", "h").agg(F.countDistinct("doc").alias("n_docs"), F.min("doc").alias("first"))
    # only counts that may pass any limit meet the hosts
    over = (counts.where(F.col("n_docs") > min_docs).join(hosts, "host")
            .where(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), share * F.col("host_docs"))))
    return lines, save(over.select("host", "h", "first"), "frequent")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """(doc_id, doc, tx, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_cut_words, gone, base_failed, kept): one row per row of
    ``docs``, with its measures, the places of its boilerplate lines and the
    verdict; (doc, tx) as in ``identity``."""
    rows = identity(docs)
    lines, over = frequent_lines(rows, min_docs, share)
    cut = (lines.join(over, ["host", "h"]).where("doc > first").groupBy("doc", "tx")
           .agg(F.sum("words").alias("cut_twice"), F.collect_set("pos").alias("gone"), F.count(F.lit(1)).alias("n")))
    # rows that repeat are counted as often as they stand; each alike
    cut = cut.select("doc", "tx", "gone", (F.col("cut_twice") * F.size("gone") / F.col("n")).cast("long").alias("n_cut_words"))
    m = measures(rows)
    out = save(m.join(cut, [m.doc == cut.doc, m.tx.eqNullSafe(cut.tx)], "left").select(
        "doc_id", m.doc, m.tx, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("n_cut_words", F.lit(0)).cast("long").alias("n_cut_words"), "gone"), "judged")
    return out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_cut_words") <= depleted * F.col("n_words")))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """(d, gone): the rows of ``docs`` that pass, as structs, with the places
    of their boilerplate lines."""
    passed = judge(docs, **options).where("kept").select("doc", "tx", "gone").dropDuplicates(["doc", "tx"])
    rows = identity(docs)
    return rows.join(passed, [rows.doc == passed.doc, rows.tx.eqNullSafe(passed.tx)]).select("d", "gone")
