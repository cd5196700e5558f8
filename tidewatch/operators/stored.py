"""The stored measurement table: its layout, and reads that stop at the dates they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import views
from tidewatch.schemas import MEASUREMENT_FIELDS

STORED = [*MEASUREMENT_FIELDS, "received_at", "seq"]
STORED_SCHEMA = (
    "event_id string, station_id string, observed_at timestamp, water_level_m double, rainfall_mm_per_hour double,"
    " flow_rate_m3s double, schema_version int, received_at timestamp, seq long"
)
DATE = "observed_date"


def store(accepted: DataFrame, path: str, name: str) -> None:
    """Write a batch's readings by date, in order of station; a repeated batch replaces its own rows."""
    (
        accepted.select(*STORED, F.to_date("observed_at").alias(DATE), F.lit(name).alias("batch"))
        .repartitionByRange(DATE, "station_id", "seq")
        .sortWithinPartitions(DATE, "station_id", "observed_at")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE, "batch").parquet(path)
    )


def dates(spark: SparkSession, path: str) -> list[str]:
    """The dates that hold readings, newest first: one folder each."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store_ = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store_.exists(root):
        return []
    names = [f.getPath().getName() for f in store_.listStatus(root)]
    return sorted((n.partition("=")[2] for n in names if n.startswith(f"{DATE}=")), reverse=True)


def of_dates(spark: SparkSession, path: str, chosen: list[str]) -> DataFrame:
    """Readings of the given dates; no other folder is listed."""
    if not chosen:
        return spark.createDataFrame([], STORED_SCHEMA)
    found = spark.read.schema(STORED_SCHEMA).option("basePath", path).parquet(*[f"{path}/{DATE}={d}" for d in chosen])
    return found.select(*STORED)


def recent(
    spark: SparkSession, path: str, limit: int = views.RECENT, condition: Column | None = None
) -> DataFrame:
    """The newest readings, of those that meet ``condition``.

    Whatever lies on a newer date is newer, so dates are read from the newest on, twice as many each time, until they
    hold ``limit`` readings. A date's rows are counted up to the limit only.
    """
    known, taken = dates(spark, path), 1
    while True:
        rows = of_dates(spark, path, known[:taken])
        rows = rows if condition is None else rows.filter(condition)
        if taken >= len(known) or rows.select("seq").limit(limit).count() >= limit:
            return views.recent(rows, limit)
        taken *= 2


def recent_of_station(spark: SparkSession, path: str, station_id: str, limit: int = views.RECENT_PER_STATION) -> DataFrame:
    return recent(spark, path, limit, F.col("station_id") == station_id)


def between(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Readings from the first to the last date (``yyyy-mm-dd``, both included)."""
    return of_dates(spark, path, [d for d in dates(spark, path) if first <= d <= last])
