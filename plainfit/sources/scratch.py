"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's own folder under ``spark.checkpoint.dir``; the folder goes when the driver's JVM ends.

    Where the setting is missing, a local session takes a temporary folder, and a cluster is refused: there, each
    executor would write to a disk of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "plainfit-shared")
    own = f"{base.rstrip('/')}/plainfit-{context.applicationId}"
    folder = context._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
