"""Measurement and station views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expr import truncate_ms


# columns used of each table; a given schema saves a footer-reading job per scan
COLUMNS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "supplier": "s_suppkey long, s_name string",
    "customer": "c_custkey long, c_name string",
    "orders": "o_orderkey long",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``events`` row as a reading of one of ten stations."""
    return _as_measurements(read_table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings as a stream of the table's files, be it one file or a folder of parts."""
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    store = table.getFileSystem(spark._jsc.hadoopConfiguration())
    files = spark.readStream.schema(COLUMNS["events"])
    if store.getFileStatus(table).isDirectory():
        return _as_measurements(files.parquet(f"{sf_dir}/events.parquet"))
    # the stream reader takes folders only
    return _as_measurements(files.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _as_measurements(events: DataFrame) -> DataFrame:
    observed = truncate_ms(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        (F.col("user_id") % 10).cast("string").alias("station_id"),
        observed.alias("observed_at"),
        (F.col("value") / 25.0).alias("water_level_m"),
        (F.get_json_object("props", "$.k").cast("double") / 4.0).alias("rainfall_mm_per_hour"),
        F.lit(None).cast("double").alias("flow_rate_m3s"),
        F.lit(1).alias("schema_version"),
        observed.alias("received_at"),
        F.col("event_id").alias("seq"),
    )


def scrambled(readings: DataFrame) -> DataFrame:
    """The same readings in a disturbed arrival order (unique, by integer arithmetic only)."""
    shift = (F.col("seq") * 7919) % 50
    return readings.withColumn("seq", (F.col("seq") + shift) * 50 + 49 - shift)


def bad_clocks(readings: DataFrame) -> DataFrame:
    """The same readings, some of them dated far ahead: by some hours, or by more than a year."""
    ahead = F.when(F.col("seq") % 97 == 0, 400 * 24).when(F.col("seq") % 89 == 3, 5).otherwise(0)
    return readings.withColumn("observed_at", F.col("observed_at") + F.make_dt_interval(hours=ahead))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations: station 0 is missing, most others never report."""
    number = (F.col("s_suppkey") + 1).cast("string")
    return read_table(spark, sf_dir, "supplier").select(
        number.alias("id"),
        F.concat(F.lit("ST-"), number).alias("station_code"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("river_name"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit("ONLINE").alias("status"),
        F.lit(None).cast("timestamp").alias("last_seen_at"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
