"""A corpus pipeline: quality rules, line dedup, near-duplicate dedup, passage dedup and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents`` (and any more that it has, whatever their names); the last returns each document's place in a
batch. All take an empty table and give an empty one, and take very long texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import lines, ngrams, packing, quality, suffixes
from plinth.llm.common import materialize
from plinth.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null and empty texts go; repeated rows, and values just at a fence, stay."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; null texts stay null, a line on just the ratio stays."""
    return lines.drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, and one row of each id.

    Texts without a word, and rows without an id, all stay.
    """
    return ngrams.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long passages that an earlier document (or place) has too; null texts and ids stay null."""
    return suffixes.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and slot; null and empty texts have length 0, equal keys are placed by length."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: SQL can't express the shingle components, the byte spans or the dynamic programme; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
