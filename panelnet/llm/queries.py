"""The queries opN_<name>: each applies its operator to a whole table of sf_dir with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelnet.llm import cotraining, imatch, licenses, near_dup, packing, quality_rules, sentence_pieces, surrogates, token_records, toxicity
from panelnet.llm.common import table


#: The key of the surrogates; a deployment passes its own.
SURROGATE_KEY = b"panelnet"


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.checked(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op3_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.scores(docs, cotraining.train(docs, table(spark, sf_dir, "labels"), cotraining.metadata(docs)))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_digest(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_records.write_records(table(spark, sf_dir, "documents"))
    return token_records.read_records(folder, manifest)


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of this query sets three words and 85 percent."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


_ALL = (
    op1_imatch_fingerprints, op2_pii_surrogates, op3_license_sentences, op4_cotraining_quality, op5_ftrl_toxicity,
    op6_sentencepiece_agenda, op7_token_records, op8_quality_rules, op9_lexical_packing, op10_minhash_near_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
