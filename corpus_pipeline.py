"""Corpus preparation in five stages, each written as Parquet and read again by the next.

toxicity             documents predicted toxic go
line_dedup           passages of two or more lines that occurred before are cut from texts
near_dedup           of similar documents (five-word shingles, similarity 0.8) the smallest doc_id stays
decontamination      documents that hold a benchmark item go
packing              the rest is packed into sequences; rows are pieces with their places

A stage takes (spark, docs, sf_dir); labels and benchmark come from sf_dir. All but the last
return the columns of documents. run() writes each stage and then deletes what the stage and its input had written.

Defined cases: a null text counts as empty but stays null; empty texts are similar to each other, so
one of them stays; a document with a null doc_id is judged by the toxicity, line and benchmark stages,
groups with no other and stays; rows that repeat a doc_id and its text are one document: they stay or go together, and each is packed; other texts
of one doc_id are documents of their own; an empty table gives an empty result at every stage; columns beside
doc_id and text are carried up to the last stage, whatever their names; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import decontamination, line_dedup, near_dedup, sequences, toxicity
from ravelin.llm.common import discard_since, materialize, release, table, written_so_far


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sequences.linear_grouping(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The stages fit models, decode fingerprints and align strings; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, mark = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_since(mark, docs)
        release(spark)
    return docs
