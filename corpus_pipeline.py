"""A corpus pipeline of five stages, each an operator of ``panelforge.llm`` applied to what the stage before kept.

Defined cases, the same for every stage: a null text is a text without words, lines or shingles, and is kept by the
filters; rows that repeat a document are judged alike by toxicity and decontamination, keep the same lines in line dedup,
and are one group in near-dedup, so one of them stays; ties (the same first line, the same group) go to the smaller
doc_id, null last; texts of any length are taken whole; an empty table, or a stage that keeps nothing, gives an empty
table with the same columns; columns that are not of documents pass through whatever their names, but for names that
begin with "__line_", which line dedup refuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, fuzzylines, mixing, simhash, toxicity
from panelforge.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that are not held out. Without labels, or
    with labels of one kind only, the score is their share: nothing goes unless most labelled documents are toxic."""
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, net)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines one stays; documents that lose all their lines go."""
    return fuzzylines.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies and the words taken."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Classifiers, signatures and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
