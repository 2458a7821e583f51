"""The corpus pipeline: quality rules, toxicity, line dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``docs``, whatever further ones there are and however they are named. ``run``
writes each stage's rows and reads them again, so that a lost executor never costs more than the stage
at work, and removes what the stage had written meanwhile. Every stage gives an empty table for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import linededup, nearcopies, packing, quality, simhash, toxicity
from tessella.llm.scratch import Scratch
from tessella.storage import close, opened


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted; the rest lose lines that are common on their source.

    Common: in more than ten texts of the source, or on a small source in more than a tenth of them, three at least.
    Null and empty texts have failed and go; rows with a null source are a source of their own; null ids
    and repeated rows are judged like others, copies of a text counting once for a line.
    """
    return quality.keep_good(docs, min_docs=3, share=0.1, most_docs=10)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.3 or more; learns from the labels of ids that are not held out.

    Null and empty texts score the base rate; null ids and repeated rows are scored like others.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    return toxicity.keep_civil(docs, model, limit=0.3)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that resemble an earlier one; documents stay, emptied ones too.

    Null texts stay null; rows with a null id are unchanged and remove nothing; rows of one id lose
    lines of the same numbers, a tie of first lines going to the lesser id and line number.
    """
    return linededup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each near-duplicate component stays, one row of it; rows with a null id stay.

    Null and empty texts are alike, and near-duplicates of each other.
    """
    return simhash.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """After ``near_duplicates``, one document stays of those that share four fifths of their five-word shingles.

    Texts without a word take no part in this second step; rows with a null id stay.
    """
    first = Scratch(spark, "fingerprinted").table(near_duplicates(spark, docs, sf_dir), "first")
    return nearcopies.keep_one(first, width=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of what is left, a token being a word; null texts have none, null ids come first."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [("quality rules", quality_rules), ("toxicity", civil), ("line dedup", first_lines), ("near dedup", near_dedup), ("packing", pack)]

#: No SQL form: the toxicity model, MinHash bands and SimHash votes. tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = opened()
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        close(opened() - before)
        if k:
            scratch.drop(str(k - 1))
    return docs
