"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing, each over what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, langid, packing, secrets, simhash
from quern.llm.shared import drop, scope, stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the models reject; learned from docs' own labelled rows."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles are at least 0.8 alike, the one with the least doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing_stage),
]

#: Fitted models, bit counts over hashes and token ids have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and read again as the next one's input.

    Nulls in any column, empty and very long texts, repeated rows and further columns pass as the operators define: null and empty
    texts are rejected by the first stage, of equal rows one is left by the second. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with scope() as keep:  # what a stage has written for itself goes with its end, its input when its result is there
            kept = keep(stage(step(spark, docs, sf_dir), name))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
