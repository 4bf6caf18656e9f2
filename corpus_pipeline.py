"""A training-corpus pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, packing, quality, secrets, simhash
from quarry.llm.common import scope, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep.

    Null and empty texts have no word and go. Each row is judged by its own text:
    null ids, ties and repeated rows are kept or dropped like any others. Other
    columns than those of ``documents`` are left out, whatever their names. An empty
    table gives an empty result.
    """
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return judged.where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows are told apart by id and text: repeated rows become one, two texts under one
    id are two documents, and rows without an id are kept or dropped one by one (one
    of them stays if all of a group are). Null, empty and blank texts are copies of
    each other. Columns, empty tables: as in ``quality_rules``.
    """
    return simhash.one_of_each(docs.select(*COLUMNS), words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A row goes because of its own text, whatever its id, null or repeated; null and
    empty texts have no passage and stay. Columns, empty tables: as in
    ``quality_rules``.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    leaks = decontamination.find_overlaps(rows, table(spark, sf_dir, "benchmark"), id_col="text_key").select("text_key").distinct()
    return rows.join(leaks, "text_key", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars`` follows the text.

    Null texts stay null, and so does their ``n_chars``; empty ones stay empty. Null
    ids and repeated rows are kept. Columns, empty tables: as in ``quality_rules``.
    """
    found = secrets.find_secrets(docs.select(*COLUMNS)).withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows that hold the corpus.

    A null or empty text is its end mark alone; null ids and repeated rows are packed
    as they come; other columns are left out; an empty table has no piece.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("secret_scan", secret_scan), ("packing", pack)]

#: Trained models and tokenizers are part of the stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again.

    What a stage has written for itself goes when its result is there. The last
    stage reads the table of the one before it, which goes with the session.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        if n == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), outer=True)
    return docs
