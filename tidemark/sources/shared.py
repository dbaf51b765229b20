"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


# paths handed out by this process
_written: list[str] = []
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    with _lock:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if named:
            return named.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(own)
        return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used; :func:`drop_tables` removes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where later steps must all see the same rows in the same partitions
    (range bounds are sampled anew for every plan), and to cut long lineage. A
    lost executor then costs one file read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Remove the tables this process has written; frames that read them end with it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count
