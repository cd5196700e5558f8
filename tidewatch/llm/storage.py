"""Intermediate tables in the shared folder, and their removal once they are no longer needed."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidewatch import session

_records: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; see ``recorded``."""
    stored = session.materialize(df, name)
    for record in _records:
        record.extend(folder_of(stored))
    return stored


def folder_of(stored: DataFrame) -> list[str]:
    return sorted({f.rpartition("/")[0] for f in stored.inputFiles()})


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders written within the block, and no others, for ``remove``."""
    record: list[str] = []
    _records.append(record)
    try:
        yield record
    finally:
        # by identity: lists that hold the same are equal
        _records[:] = [r for r in _records if r is not record]


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders of the shared folder, once what was made from them is written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are written: Spark removes them when the driver
    collects its garbage, which it may not do for a long time by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
