"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset, in local runs, a temporary folder that goes with the process. RuntimeError on a cluster without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Has Spark drop a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The tables written in each open scratch(), the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are deleted at the end, so that a session of many queries does not fill the shared folder. What is made of them must be read or written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialized(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a written table: what is read several times is computed once, plans stay small, and no lost executor costs a rerun of all.

    The shuffle files of its plan go once the table is written; else they would stay until the driver collects garbage.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"  # one folder an application, to delete when it ends
    if _SCOPES:
        _SCOPES[-1].append(at)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


#: A single file of these sizes is read by one task where several would pay.
SPREAD_BYTES, SPLIT_BYTES = 1 << 20, 128 << 20


def read_table(spark: SparkSession, folder: str, name: str, fixed: bool = False) -> DataFrame:
    """The Parquet table name under folder. One that is a single small file, so that one task reads it, is dealt over the cores; fixed: as a written table, so that it comes out alike whenever it is read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    files = df.inputFiles()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if len(files) != 1 or not SPREAD_BYTES < size < SPLIT_BYTES:
        return df
    dealt = df.repartition(spark.sparkContext.defaultParallelism)
    return materialized(dealt, name) if fixed else dealt
