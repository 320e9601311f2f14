"""The queries of the ten operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extendible_shards, language_id, license_scan, line_dedup, lm_score, pii_surrogates, simhash, source_mix, vptree_ann
from .common import crc_mod, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, crc_mod(F.col("doc_id"), 5) == 0)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards.shard_report(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pii_report(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_documents(docs, crc_mod(F.col("doc_id"), 7) == 2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op9_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree_ann.ann_report(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_source_mix, op4_line_dedup, op5_extendible_shards, op6_pii_surrogates, op7_lm_score, op8_simhash, op9_vptree_ann, op10_decontaminate)}
ORACLE_SQL = {
    "op3_source_mix": source_mix.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op5_extendible_shards": extendible_shards.ORACLE_SQL,
}
