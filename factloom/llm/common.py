"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import reach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3; remainder 1 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows and few bytes, as texts may be long."""
    reach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


@contextmanager
def no_collection() -> Iterator[None]:
    """Without Python's search for cycles, which looks at the many strings of a batch again and again and finds none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def fresh(name: str, *taken: list[str]) -> str:
    """A column name like ``name`` that none of the lists has, in any case."""
    used = {c.lower() for cols in taken for c in cols}
    while name.lower() in used:
        name += "_"
    return name


#: Elements of an array that are accumulated at a time.
_RUN = 64


def running(values: Column, most: bool = False) -> Column:
    """The sums of an integer array's elements so far, or the largest so far, in time that follows its length: runs of
    elements are accumulated by themselves, as each append copies what it appends to. ``values`` should be a column that
    is there already, as it is read again for each run."""
    step = (lambda a, x: F.greatest(a, x)) if most else (lambda a, x: a + x)
    nothing = F.array().cast("array<int>")

    def one(at: Column, run: Column) -> Column:
        found = F.aggregate(F.slice(values, run * _RUN + 1, F.lit(_RUN)), F.array(at), lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x)))
        return F.slice(found, 2, F.size(found))

    runs = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int"))
    parts = F.aggregate(runs, F.array(nothing), lambda acc, run: F.array_append(acc, one(F.coalesce(F.try_element_at(F.element_at(acc, -1), F.lit(-1)), F.lit(0)), run)))
    return F.when(F.size(values) > 0, F.flatten(parts)).otherwise(nothing)
