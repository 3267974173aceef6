"""From raw documents to tokens: quality rules, line dedup, near-duplicates,
mixing, SentencePiece.  Each stage is one operator of ``ledgerlens.llm``; its
result is written as Parquet and read again as the next stage's documents.

Defined results of the stages: a document without words goes in the first one;
rows that repeat in all of id and text are one row after near-duplicates; of a
group of near-duplicates without any doc_id the rows of one text stay; a null
doc_id counts as the largest in line dedup and shares one hash in the mix;
empty tables stay empty; extra columns travel to the mix and end there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup, mixing, near_dup, pieces, quality
from ledgerlens.llm.common import LAST, WORD, identity, save, with_text, without_lines


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their boilerplate lines."""
    return without_lines(quality.kept_rows(docs)).select(*with_text("d", F.col("text"), docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds; one that
    has no word left (a copy of earlier documents) goes."""
    left = line_dedup.dedup_lines(docs).select(*with_text("d", F.col("text"), docs.columns))
    return left.where(F.rlike("text", F.lit(WORD)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    kept = (near_dup.near_duplicates(docs).where("kept")
            .select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "tx").distinct())
    rows = identity(docs)
    found = rows.join(kept, [rows.doc == kept.doc, rows.tx.eqNullSafe(kept.tx)], "left_semi")
    return found.dropDuplicates(["doc", "tx"]).select("d.*")  # of rows that repeat, one


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs, weights=(3, 1, 2), total=1.5, max_repeat=2.0)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of every document of the mix."""
    return pieces.encode(docs.select("doc_id", "source", "text")).select(
        "d.doc_id", "d.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Mixing follows md5 order, near-duplicates signatures and tokens a
#: vocabulary file: not for SQL; checked against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
