"""The corpus pipeline: documents through the operators' decisions, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and lets its decisions take
effect; all but the last return the columns of documents. Rows without a doc_id go in the first
stage that sees them. An empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, latent, neardup, quality_rules, secrets
from quillon.llm.common import Written, load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; the cutoffs are proven on the labels."""
    return _documents(quality_rules.accepted(docs, load(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; null and empty texts, which have no copies, too.

    Of rows that repeat an id one stays, so that an id names one document from here on.
    """
    return _documents(neardup.one_of_each(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go; null and empty texts stay."""
    return _documents(latent.without_leaks(docs, load(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts, whatever their length, are replaced by the name of their kind; a null text stays null."""
    return _documents(secrets.redacted(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, decoded again and compared; a null or empty text has none."""
    return bpe.encoded_and_decoded(docs)


STAGES = [("quality rules", quality), ("minhash near-dedup", near), ("benchmark decontamination", decontaminate), ("secret scan", redact), ("bpe", tokens)]

ORACLE_SQL = None  #: near copies and latent retrieval aren't expressible in SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written and read again as the next one's.

    A stage's table goes when the next one's is written; the last stage reads the only one that stays.
    """
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = Written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
