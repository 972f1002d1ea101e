"""Intermediate tables in the folder that the driver and all executors share.

A staged table cuts the lineage and survives the loss of any executor, as its files are in
``spark.checkpoint.dir`` and not on one machine. Nothing is kept in executor-local storage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be broadcast; about 100 MB as a hash relation.
BROADCAST_ROWS = 1_000_000


def folder(spark: SparkSession) -> str:
    """The shared folder. A local temporary one is set only where the session names none and all of Spark runs in
    this process; on a cluster the executors' temporary folders are not shared, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    for paths in _SCOPES:
        paths.append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    remove(df.sparkSession, df.staged_at)


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all tables that were staged inside; what is read later must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; meant for staged tables, where counting is cheap."""
    return df.count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else as it is (a shuffle join)."""
    return F.broadcast(df) if small(df, rows) else df
