"""Scratch tables and column helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="provlake-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only in local mode, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or _own_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table or archive that a later step reads."""
    return f"{scratch_root(spark).rstrip('/')}/provlake-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back.

    The table cuts the lineage: a lost executor costs the reread of a file, not the recomputation of what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once, in Spark's checkpoint folder; unlike a table it keeps its partitions and the order of their rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def discard(df: DataFrame) -> None:
    """Delete the scratch table that df is, once no later step reads it."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith("provlake-"):
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


@functools.cache
def _shipped(application: str, context: SparkContext) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        folder = tempfile.mkdtemp(prefix="provlake-")
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(f"{folder}/provlake", "zip", root, "provlake"))


#: Rows that go to a Python worker at once, where the session leaves Spark's own number: texts can be long.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give executors this package, unless PYTHONPATH already does (once for each application), and keep Arrow batches small."""
    _shipped(spark.sparkContext.applicationId, spark.sparkContext)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
