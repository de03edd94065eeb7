"""A corpus pipeline: quality rules, toxicity, near-duplicates, surrogates, packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelnet.llm import near_dup, packing, quality_rules, surrogates, toxicity
from panelnet.llm.common import new_path, remove, table
from panelnet.llm.queries import SURROGATE_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity, learnt from the labelled ones among docs."""
    return toxicity.not_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates: five words, 0.8."""
    return near_dup.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return surrogates.anonymous(docs, SURROGATE_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, each window filled with a seed document's lexical neighbours."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("toxicity", civil), ("near_dedup", distinct), ("pii", private), ("packing", packed)]
#: A learnt classifier, minima and keyed permutations are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written as Parquet and read by the next.

    Null texts count as empty, rows without an id or with a repeated one go through each stage as documents of their own,
    other columns of documents pass through to the last stage, an empty table gives no piece. Once the next stage is
    written, nothing reads a stage's table again and it is deleted, unless keep says otherwise; the last one stays for
    the result to be read from.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before and not keep:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
