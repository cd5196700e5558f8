"""Silent stations: the processing-time timeout, replayed over receive times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.functions.expr import div, epoch_ms, iso_instant, json_object
from tidewatch.operators.rules import as_candidates
from tidewatch.schemas import STATION_STALE


def last_observed(readings: DataFrame) -> DataFrame:
    """Event time of each station's last arrival (not the highest event time)."""
    return readings.groupBy("station_id").agg(F.max_by("observed_at", "seq").alias("last_observed_at"))


def stale_gaps(readings: DataFrame, config: RuleConfig, as_of: Column | None = None) -> DataFrame:
    """One row per silence of at least the timeout, fired at last receive time + timeout.

    A timeout-wide cell of receive time cannot hold such a silence, so readings shrink to the first
    and last arrival per (station, cell) before any shuffle; only cells are windowed per station.
    A reading landing exactly at the timer instant comes too late. The last reading of a station
    fires when ``as_of`` (the clock at the end of the replay) has reached its timer; with
    ``as_of=None`` its timer stays pending.
    """
    received = epoch_ms("received_at")
    cells = (
        readings.withColumn("received_ms", received)
        .groupBy("station_id", div(F.col("received_ms"), config.stale_ms).alias("cell"))
        .agg(
            F.min("received_ms").alias("first_ms"),
            F.max(F.struct("received_ms", "seq", epoch_ms("observed_at").alias("observed_ms"))).alias("last"),
        )
    )
    ordered = Window.partitionBy("station_id").orderBy("cell")
    fire = F.col("last.received_ms") + config.stale_ms
    ended = F.lit(False) if as_of is None else epoch_ms(as_of) >= F.col("fire_ms")
    return (
        cells.withColumn("next_ms", F.lead("first_ms").over(ordered))
        .withColumn("fire_ms", fire)
        .filter(F.coalesce(F.col("next_ms") >= F.col("fire_ms"), ended))
        .select("station_id", "fire_ms", F.col("last.observed_ms").alias("last_observed_ms"))
    )


def stale_texts(config: RuleConfig) -> tuple[Column, Column]:
    """Reason and evidence of a silence."""
    observed = iso_instant(F.timestamp_millis("last_observed_ms"))
    minutes = F.lit(config.stale_min)
    reason = F.format_string(
        "No accepted reading for station in over %d minutes (last observed: %s)", minutes, observed
    )
    evidence = json_object(
        stationId=F.col("station_id"), lastObservedAt=observed, staleTimeoutMinutes=minutes
    )
    return reason, evidence


def stale_candidates(gaps: DataFrame, config: RuleConfig) -> DataFrame:
    """Candidates of the stale rule; event time and order = timer instant."""
    return as_candidates(
        gaps.withColumn("seq", F.col("fire_ms")), STATION_STALE, *stale_texts(config),
        F.timestamp_millis("fire_ms"),
    )
