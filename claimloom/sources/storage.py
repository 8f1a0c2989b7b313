"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the session's JVM ends.

    Where the setting is absent, a local master gets a temporary folder; a cluster, whose executors
    couldn't share one, gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="claimloom-"))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/claimloom-{uuid.uuid4().hex}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return where.toString()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows of df as a table in the shared folder: worked out once, of known size, without lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
