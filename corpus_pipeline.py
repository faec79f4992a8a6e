"""Corpus preparation in five stages; each stage reads what the one before it wrote.

Language ID drops documents whose language can't be told; near-dedup keeps one document of
each SimHash component; decontamination drops documents with benchmark windows; the secret scan
replaces secrets in the texts; mixing says how many words of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import langid, mixing, secrets, simhash, winnowing
from ledgerlens.llm.common import fresh, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = langid.fit(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    pred, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = langid.identify(docs, filters, pred_col=pred, score_col=score)
    return found.where(F.col(pred) != langid.UNDETERMINED).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]

#: Fingerprint majorities and seeded block selection have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between two stages is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
