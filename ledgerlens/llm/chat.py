"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by (turn, role, text),
runs of one role are merged by array aggregation, and the runs are joined into
one string::

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Texts of a merged run stay apart at ``<|im_sep|>``.  In texts and roles every
``<`` + backslashes + ``|`` gains a backslash, so no control string can arise
inside a text and the escape is reversible; a role also has its ``%`` and line
breaks percent-coded.  The loss mask is run-length coded: per run of one role,
and within it per text, how many code points are skipped and then kept.

Defined results: a null text or role is empty; a null turn comes first; equal
turns are ordered by role and text; repeated rows are all kept; a null conv_id
is a conversation of its own; extra columns are ignored.  A conversation is
one output row and must fit in one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask is an array of
    (skip, keep) code points that cover ``formatted`` in order."""
    t = turns.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # escape once per row of the array
    rows = rows.select("conv_id", F.transform("turns", lambda x: F.struct(
        escaped_role(x["role"]).alias("role"), escaped(x["text"]).alias("text"), (x["role"] == TRAINED).alias("on"))).alias("turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")),
                      lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    rows = rows.select("conv_id", "turns", starts.alias("starts"))
    runs = F.transform("starts", lambda s, k: F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s))
    rows = rows.select("conv_id", runs.alias("runs"))
    piece = F.transform("runs", lambda r: F.concat(
        F.lit(START), r[0]["role"], F.lit("\n"), F.array_join(F.transform(r, lambda x: x["text"]), SEP), F.lit(END)))

    def mask(r: Column) -> Column:
        head = F.lit(len(START) + 1) + F.length(r[0]["role"])
        spans = F.transform(r, lambda x, i: F.struct(
            (F.when(i == 0, head).otherwise(F.lit(len(SEP)))
             + F.when(x["on"], F.lit(0)).otherwise(F.length(x["text"]))).cast("long").alias("skip"),
            F.when(x["on"], F.length(x["text"])).otherwise(F.lit(0)).cast("long").alias("keep")))
        return F.concat(spans, F.array(F.struct(F.lit(len(END)).cast("long").alias("skip"), F.lit(0).cast("long").alias("keep"))))

    return rows.select("conv_id", F.array_join(piece, "").alias("formatted"),
                       F.flatten(F.transform("runs", mask)).alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Back from the output alone: ``turns`` (role, text) and ``loss_text``,
    the unescaped text under the mask."""
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    cut = F.slice(parts, F.lit(2), F.size(parts))
    runs = F.transform(cut, lambda p: F.struct(
        F.substring_index(p, "\n", 1).alias("role"),
        F.split(F.regexp_replace(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2), r"<\|im_end\|>\n\z", ""),
                r"<\|im_sep\|>", -1).alias("texts")))
    rows = formatted.select("*", runs.alias("runs"))
    turns = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda x: F.struct(
        unescaped_role(r["role"]).alias("role"), unescaped(x).alias("text")))))
    # the spans of the mask, each within the stretch of the output it covers: one
    # stretch per text, cut at the marks that cannot stand inside a text
    stretch = F.filter(F.split("formatted", r"(?=<\|im_(?:start|sep|end)\|>)", -1), lambda s: s != "")
    both = rows.select("*", turns.alias("turns"), stretch.alias("stretch"))
    under = F.zip_with("stretch", "loss_mask", lambda s, m: F.when(m["keep"] > 0, unescaped(
        F.substr(s, (m["skip"] + 1).cast("int"), m["keep"].cast("int")))).otherwise(F.lit("")))
    return both.withColumn("loss_text", F.array_join(under, "")).drop("runs", "stretch")
