"""Cutting a plan by writing an intermediate table to the shared folder.

Per-row lookups use their question frame several times; without a cut each
use would compute it again.  A written table survives the loss of executors,
keeps its columns prunable, and has a known size, so Spark broadcasts it only
when it is small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must see.

    Where it is unset, a local session uses its warehouse folder; any other
    session is told to name one, as its default warehouse is on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder, removed when the driver's JVM ends in good order."""
    folder = f"{shared_folder(spark)}/ballotlake/{spark.sparkContext.applicationId}"
    known = spark.__dict__.setdefault("_ballotlake_folders", set())
    if folder not in known:
        path, files = _path(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        known.add(folder)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, nothing written yet."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` now and gives the written table."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
