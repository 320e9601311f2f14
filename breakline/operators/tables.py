"""Intermediate tables in the folder that all executors share: they cut the lineage of loops and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset and all runs on one machine."""
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="breakline-"))
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    path = f"{shared_root(df.sparkSession)}/breakline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
