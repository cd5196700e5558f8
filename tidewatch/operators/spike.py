"""Rolling-median baseline and the sensor-spike rule, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.functions.expr import div, epoch_ms, iso_instant, json_object
from tidewatch.functions.median import RollingMedian
from tidewatch.operators.arrival import KEY_CHUNK_ROWS, key_chunks
from tidewatch.operators.rules import as_candidates
from tidewatch.schemas import SENSOR_SPIKE
from tidewatch.session import materialize

BASELINE = (
    "station_id string, seq long, event_ms long, level_m double, "
    "baseline_count int, baseline_median_m double"
)

SAMPLE = ["station_id", "seq", "event_ms", "level_m"]
# chunk maxima looked at in one step
BLOCK_CHUNKS = 512


def lead_ins(chunked: DataFrame, window_ms: int, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """Rows of ``chunked(station_id, chunk, seq, event_ms, level_m)`` that are still samples when a later chunk of their
    station begins, once for every such chunk (``chunk``).

    A sample is alive after its own chunk if no later arrival there is a window or more ahead of it (a suffix
    maximum), and stays so up to the first later chunk whose highest event time is. One row per chunk tells that:
    a sample that no later chunk ends goes to all of them, and of the others the first chunk that does is looked up among
    the maxima of ``block_chunks`` chunks at a time. A reading dated far ahead is one row per chunk of its station and
    gathers nothing, since it ends samples that arrived before it only.
    """
    following = Window.partitionBy("station_id", "chunk").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    limit = F.col("event_ms") + window_ms
    later = F.max("event_ms").over(following)
    alive = chunked.withColumn("_later", later).filter(F.coalesce(F.col("_later") <= limit, F.lit(True))).drop("_later")
    highest = chunked.groupBy("station_id", "chunk").agg(F.max("event_ms").alias("highest"))
    station = Window.partitionBy("station_id").orderBy("chunk")
    behind = station.rowsBetween(1, Window.unboundedFollowing)
    summaries = materialize(highest.select(
        "station_id", "chunk", "highest", F.max("highest").over(behind).alias("ahead"),
        F.max("chunk").over(Window.partitionBy("station_id")).alias("last")), "chunk-maxima")
    blocks = summaries.groupBy("station_id", div(F.col("chunk"), block_chunks).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("chunk", "highest"))).alias("maxima"))
    samples = materialize(
        alive.join(summaries.filter("chunk < last").drop("highest"), ["station_id", "chunk"]).withColumnsRenamed(
            {"chunk": "since"}), "samples")
    found = samples.filter(F.col("ahead") <= limit).select(*SAMPLE, (F.col("since") + 1).alias("first"), "last")
    open_ = samples.filter(F.col("ahead") > limit).withColumn("first", F.col("since") + 1)
    while not open_.isEmpty():
        block = div(F.col("first"), block_chunks)
        met = open_.withColumn("block", block).join(blocks, ["station_id", "block"])
        ends = F.filter("maxima", lambda m: (m["chunk"] >= F.col("first")) & (m["highest"] > limit))
        met = materialize(met.select(
            *SAMPLE, "first", "block", F.get(ends, F.lit(0))["chunk"].alias("end")), "lead-ins")
        # the chunk that ends a sample still begins with it
        block_end = (F.col("block") + 1) * block_chunks - 1
        found = found.unionByName(met.select(*SAMPLE, "first", F.coalesce("end", block_end).alias("last")))
        open_ = met.filter("end IS NULL").select(*SAMPLE, (block_end + 1).alias("first"))
    return found.select(*SAMPLE, F.explode(F.sequence("first", "last")).alias("chunk"))


def spike_baseline(readings: DataFrame, config: RuleConfig, chunk_rows: int = KEY_CHUNK_ROWS) -> DataFrame:
    """Every level-bearing reading with the size and exact median of its baseline.

    The baseline of a reading are the earlier arrivals that survived pruning: whenever a reading
    with event time t arrives, samples before t - window leave for good. Work is cut by (station, chunk
    of arrivals), each chunk also getting the samples that are alive when it begins: exact for any
    arrival order and any clock, and a hot station spreads over as many tasks as it has chunks.

    A sliding exact median has no bounded-cost SQL form (a range frame re-sorts itself for every
    row and cannot follow arrival order), so the last step streams sorted Arrow batches through a
    small two-heap helper; memory is the live baseline of one station.
    """
    window_ms = config.spike_window_ms
    levels = readings.filter(F.col("water_level_m").isNotNull()).select(
        "station_id", "seq", epoch_ms("observed_at").alias("event_ms"),
        F.col("water_level_m").alias("level_m"),
    )
    chunked, several = key_chunks(levels, ["station_id"], chunk_rows)
    laid_out = chunked.withColumn("own", F.lit(True))
    if several:
        laid_out = laid_out.unionByName(lead_ins(chunked, window_ms).withColumn("own", F.lit(False)))
    ordered = laid_out.repartition("station_id", "chunk").sortWithinPartitions("station_id", "chunk", "seq")

    def baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, samples = None, None
        for batch in batches:
            counts, medians, own = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("station_id", "chunk", "own", "event_ms", "level_m"))
            for station, chunk, is_own, ms, level in zip(*columns, strict=True):
                if (station, chunk) != current:
                    current, samples = (station, chunk), RollingMedian()
                samples.expire(ms - window_ms)
                size = len(samples)
                counts.append(size)
                own.append(is_own)
                medians.append(samples.median() if size and is_own else None)
                samples.add(ms, level)
            kept = [batch.column(c) for c in ("station_id", "seq", "event_ms", "level_m")]
            judged = pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int32()), pa.array(medians, pa.float64())],
                names=["station_id", "seq", "event_ms", "level_m", "baseline_count", "baseline_median_m"],
            )
            yield judged.filter(pa.array(own, pa.bool_()))

    return ordered.mapInArrow(baselines, BASELINE)


def spikes(baseline: DataFrame, config: RuleConfig) -> DataFrame:
    """Warm baselines whose median lies at least the threshold away; ``delta_m`` keeps its sign."""
    delta = F.col("level_m") - F.col("baseline_median_m")
    return baseline.filter(F.col("baseline_count") >= config.spike_warmup).withColumn(
        "delta_m", delta
    ).filter(F.abs("delta_m") >= F.lit(config.spike_m))


def spike_texts(config: RuleConfig) -> tuple[Column, Column]:
    """Reason and evidence of a fired spike row."""
    level, median, delta = F.col("level_m"), F.col("baseline_median_m"), F.col("delta_m")
    threshold = F.lit(config.spike_m)
    reason = F.format_string(
        "Water level %.2fm differs from %dh baseline median %.2fm by %.2fm (>= %.2fm threshold)",
        level, F.lit(config.spike_window_min // 60), median, F.abs(delta), threshold,
    )
    evidence = json_object(
        stationId=F.col("station_id"),
        eventTimestamp=iso_instant(F.timestamp_millis("event_ms")),
        waterLevelM=level,
        baselineMedianM=median,
        deltaM=delta,
        thresholdM=threshold,
        baselineSampleCount=F.col("baseline_count"),
    )
    return reason, evidence


def spike_candidates(fired: DataFrame, config: RuleConfig) -> DataFrame:
    """Candidates of the spike rule; event time = the reading's."""
    return as_candidates(fired, SENSOR_SPIKE, *spike_texts(config), F.timestamp_millis("event_ms"))
