"""Queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, lexicon, licenses, media, pii, repair, secret_scan, sharding, simhash, toxicity
from .shared import table


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.digests(table(spark, sf_dir, "documents"))


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.containers(table(spark, sf_dir, "documents")))


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_output(table(spark, sf_dir, "documents"))


def op8_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op10_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.families(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_extendible_shards, op2_boosted_pii, op3_spaced_seed_leaks, op4_bpe_lexicon, op5_iso_media, op6_simhash_tiles, op7_repair_ids, op8_weak_toxicity, op9_randomness_secrets, op10_license_paragraphs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_extendible_shards": sharding.oracle()}
