"""A training-data pipeline of five operators. Each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm import decontam, lexicon, secret_scan, simhash, toxicity
from hashloom.llm.shared import drop_stored, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model is fitted on labelled documents of this stage's input. Null texts count as empty
    and stay; rows of one doc_id are judged each; without labels of both classes all stay."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near-duplicates stays, that of the smallest doc_id. Texts without words are one group; rows that share
    a doc_id but not a text are judged each."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go. Null texts stay; an empty benchmark removes nothing."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by marks, and n_chars follows. Null texts stay null."""
    return secret_scan.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of them and of the text decoded from them. A null text is an empty one."""
    return lexicon.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("bpe encoding and decoding", bpe_stage),
]

#: SQL can't express the trained and hashed stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            made, docs = docs, stored(docs, f"stage-{k}")
            drop_stored(made)  # the stage before, and what this one kept on its way
    return docs
