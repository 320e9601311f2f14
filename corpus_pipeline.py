"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakline.llm import decontaminate, extendible_shards, language_id, near_copies, simhash, source_mix
from breakline.llm.common import Apart, crc_mod, materialise, table


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without a letter, and those whose n-grams are out of place in every profile."""
    return language_id.keep_known(docs, crc_mod(F.col("doc_id"), 5) == 0)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike by 0.8 or more) stays, the one with the smallest id.

    SimHash links them where fingerprints are near and an exact check agrees; prefix filtering adds those that it misses.
    """
    return simhash.near_dedup(docs, groups=near_copies.grouped)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return source_mix.mix(docs)


def stage_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard (columns shard, shard_depth, shard_bytes; with an underscore in front where the caller has such a column)."""
    own = Apart(docs)
    got = extendible_shards.assign_shards(own.df, id_col=own.name("doc_id"), text_col=own.name("text"))
    added = {"shard": "id", "shard_depth": "depth", "shard_bytes": "shard_bytes"}
    return own.back(got.select(*own.own, *[F.col(f"_shard.{f}").alias(n) for n, f in added.items()]), *added)


STAGES = [
    ("language_id", stage_language),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("source_mix", stage_mix),
    ("shards", stage_shards),
]

#: The stages train profiles and compare sets of shingles; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
