"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "skyloom") -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, on one machine only, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_skyloom_shared", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        spark._skyloom_shared = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark names it, for use in tasks."""
    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest)


def folder(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def saved(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """The table written in the shared folder and read again: cuts lineage, and outlives any executor.

    It is deleted by ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.options(**options).parquet(path)
    fs, where = folder(spark, path)
    fs.deleteOnExit(where.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def needs(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """Notes which saved tables ``df`` still reads, for ``settled``."""
    df._needs = tables
    return df


def settled(df: DataFrame, source: DataFrame, name: str = "table") -> DataFrame:
    """``df`` saved, whereupon what ``source``, of which it is made, has needed goes."""
    out = saved(df, name)
    discard(*getattr(source, "_needs", ()))
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_saved_at", None)
        if path:
            fs, where = folder(df.sparkSession, path)
            fs.delete(where.getParent(), True)
