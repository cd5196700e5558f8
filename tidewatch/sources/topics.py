"""Topics: Kafka where its connector is on the classpath, a folder of JSON lines otherwise.

Both give ``seq, key, value, received_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.schemas import RAW

SEQ_HEADER = "seq"


def read_kafka(
    spark: SparkSession, config: RuleConfig, topic: str, partitions: int, per_trigger: int = 1_000_000
) -> DataFrame:
    """Stream a topic from its start on first ever run; afterwards the query's checkpoint decides.

    ``partitions``: the topic's partition count, for the arrival numbers. ``per_trigger`` bounds a
    micro-batch, and with it what keyed operators hold of one key at a time.
    """
    return from_kafka(
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", config.bootstrap_servers)
        .option("groupIdPrefix", config.consumer_group)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load(),
        partitions,
    )


def from_kafka(records: DataFrame, partitions: int) -> DataFrame:
    """Kafka's columns as a raw record.

    The arrival number is the one an earlier job put into the header; else offset * partitions + partition:
    unique, ordered per partition and about as dense as the offsets. A record of a partition beyond the
    count fails the query, as its number would be another record's.
    """
    own = F.when(F.col("partition") < partitions, F.col("offset") * partitions + F.col("partition")).otherwise(
        F.raise_error(F.concat(F.lit("more partitions than stated: "), F.col("partition").cast("string"))).cast("long"))
    carried = F.filter(F.col("headers"), lambda h: h["key"] == SEQ_HEADER)
    carried = F.try_element_at(carried, F.lit(1))["value"].cast("string").cast("long")
    return records.select(
        F.coalesce(carried, own).alias("seq"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("received_at"),
    )


def read_folder(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream a folder of JSON-line files with the raw record schema, some files per micro-batch."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(path)


def in_arrival_order(records: DataFrame) -> DataFrame:
    """Records as Kafka's writer takes them: all of a key in one partition, in arrival order, each with
    its arrival number in a header. Records without a key are spread by that number."""
    header = F.array(F.struct(
        F.lit(SEQ_HEADER).alias("key"), F.col("seq").cast("string").cast("binary").alias("value")))
    spread = F.when(F.col("key").isNull(), F.col("seq"))
    return (
        records.repartition(F.col("key"), spread)
        .sortWithinPartitions("seq")
        .select("key", "value", header.alias("headers"))
    )


def write_kafka(records: DataFrame, config: RuleConfig, topic: str) -> None:
    """Batch write inside ``foreachBatch``, per key in arrival order; records without a key keep a null key."""
    (
        in_arrival_order(records)
        .write.format("kafka")
        .option("includeHeaders", "true")
        .option("kafka.bootstrap.servers", config.bootstrap_servers)
        .option("topic", topic)
        .save()
    )


def batch_name(spark: SparkSession, batch_id: int) -> str:
    """Names a micro-batch for good: the query's id, which lives in its checkpoint, and the batch's number.

    Numbers alone begin again with every new checkpoint, and would name another run's batches.
    """
    run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    return f"{run}-{batch_id:012d}"


def write_folder(records: DataFrame, path: str, batch_id: int) -> None:
    """One sub-folder per micro-batch: running a batch again replaces its own output, and nothing else."""
    records.write.mode("overwrite").json(f"{path}/batch={batch_name(records.sparkSession, batch_id)}")
