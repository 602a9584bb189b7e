"""Scratch space that all executors share, and lineage cut there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "file:///tmp/checkpoints"  # of a single machine alone


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session has a folder of its own where that is unset, a cluster without it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def new_folder(spark: SparkSession, kind: str = "stored") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read back, in columns; the files stay."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
