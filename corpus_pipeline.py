"""A cleaning pipeline over ``documents``: toxic texts, repeated lines, near copies and benchmark text go; the rest is packed.

Edge cases of every stage: null and empty texts are clean, have no repeated lines,
copies or hits, and stay; null ids and repeated rows are rows of their own but for
near copies, where rows with one doc_id and text count once; of ties the first by
doc_id stays; very long texts are worked on whole; an empty table gives an empty
result; further columns are passed on to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.decontamination import drop_contaminated
from ravelin.llm.line_dedup import drop_repeated_lines
from ravelin.llm.minhash import drop_near_copies
from ravelin.llm.packing import pack_documents
from ravelin.llm.toxicity import drop_toxic
from ravelin.scratch import Scratch
from ravelin.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three lines in a row; those of which no line is left go."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Training a classifier and rounding a linear program can't be said in SQL; the tests restate each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read by the next."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
