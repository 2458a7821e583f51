"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage: a lost executor costs the tasks it ran, never the stages before
the table. Operators drop what they no longer need; what a returned frame still reads goes when
``close_all`` is called or the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set (tests, one machine)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the cluster's own clean-up takes the folder
        return


_open: dict[str, SparkSession] = {}


def close_all() -> None:
    """Remove every scratch table of this process. Frames that still read one fail afterwards."""
    for path in list(_open):
        _delete(_open.pop(path), path)


def opened() -> set[str]:
    """The scratch folders that stand now."""
    return set(_open)


def close(folders: set[str]) -> None:
    """Remove these scratch folders, once what read them has been written."""
    for path in folders & set(_open):
        _delete(_open.pop(path), path)


atexit.register(close_all)


class Scratch:
    """A new folder of intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"
        _open[self.path] = spark

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
