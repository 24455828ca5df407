"""Cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="provlake-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only in local mode one of our own where none is named, as executors don't share it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or _local_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/provlake-{name}-{uuid.uuid4().hex}"


@cache
def _checkpoints(context: object) -> None:
    context.setCheckpointDir(_local_folder())


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        shared_folder(spark)
        _checkpoints(spark.sparkContext)
    return df.checkpoint()  # which computes df once


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again.

    Where a loop makes each table from the one before: a checkpoint keeps what the optimizer knows of df's columns, and that
    grows by the square or worse with coalesced columns; a file brings its size and nothing else.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
