"""Sliding event-time windows: late readings and the fast-rise rule."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.functions.expr import div, epoch_ms, floor_to, iso_instant, json_object
from tidewatch.operators.arrival import CHUNK_ROWS, previous_max
from tidewatch.operators.rules import as_candidates
from tidewatch.schemas import LEVEL_RISING_FAST


def _window_starts(cell: Column, config: RuleConfig) -> tuple[Column, Column]:
    """First and last start of the epoch-aligned windows ``[start, start + size)`` over ``cell``."""
    size, slide = config.rising_window_ms, config.rising_slide_ms
    last = floor_to(cell, slide)
    return last - div(size - 1 - (cell - last), slide) * slide, last


def _first_open(first: Column, config: RuleConfig) -> Column:
    """Earliest start >= ``first`` whose window was still open when the reading arrived.

    A window is closed once its end <= (highest event time seen before) - allowed delay.
    """
    size, slide = config.rising_window_ms, config.rising_slide_ms
    overdue = F.col("prev_max_ms") - config.watermark_ms - (first + size)
    closed = F.when(overdue >= 0, div(overdue, slide) + 1).otherwise(F.lit(0))
    return first + closed * slide


def _split_by_clock(
    readings: DataFrame, config: RuleConfig, chunk_rows: int
) -> tuple[DataFrame, DataFrame]:
    """(readings sure to be punctual, the others with ``prev_max_ms``); both carry ``ms``.

    ``prev_max_ms`` is the highest event time among all earlier arrivals. A stretch of arrivals is
    punctual when the first window of its earliest reading is still open at its very end.
    """

    def punctual(lowest: Column, highest: Column) -> Column:
        first, _ = _window_starts(lowest, config)
        return first + config.rising_window_ms > highest - config.watermark_ms

    return previous_max(
        readings.withColumn("ms", epoch_ms("observed_at")), F.col("ms"), "prev_max_ms", punctual, chunk_rows
    )

#: more than there are arrival numbers, negative ones included
ARRIVALS = Decimal(2 * 10**19)
KEY = "decimal(38,0)"


def late_readings(readings: DataFrame, config: RuleConfig, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Readings none of whose windows was still open on arrival (record-granular replay)."""
    _, clocked = _split_by_clock(readings, config, chunk_rows)
    first, last = _window_starts(F.col("ms"), config)
    return clocked.filter(_first_open(first, config) > last)


def flag_late(previous_max_ms: Column, config: RuleConfig) -> Column:
    """Batch-granular late flag for a micro-batch: every window closed by earlier batches."""
    end = floor_to(epoch_ms("observed_at"), config.rising_slide_ms) + config.rising_window_ms
    return F.coalesce(end <= previous_max_ms - config.watermark_ms, F.lit(False))


def boundary_readings(ms: Column) -> list[Column]:
    """Aggregates for the earliest and the latest reading; the first arrival wins a tie.

    Time and arrival make one number of fixed width, so that the aggregates are updated in place and no
    partition has to be sorted beforehand.
    """
    time = ms.cast("decimal(18,0)") * F.lit(ARRIVALS)
    seq = F.col("seq").cast("decimal(19,0)")
    return _boundaries(
        (time + seq).cast(KEY), (time - seq).cast(KEY), ms, ms, F.col("water_level_m"), F.col("water_level_m"))


def _boundaries(
    early: Column, late: Column, early_ms: Column, late_ms: Column, early_level: Column, late_level: Column
) -> list[Column]:
    return [
        F.min(early).alias("earliest_key"), F.min(early_ms).alias("earliest_ms"),
        F.min_by(early_level, early).alias("earliest_level_m"),
        F.max(late).alias("latest_key"), F.max(late_ms).alias("latest_ms"),
        F.max_by(late_level, late).alias("latest_level_m"),
    ]


def rising_windows(
    readings: DataFrame,
    config: RuleConfig,
    arrival_replay: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Earliest and latest level of every (station, window) that holds two points in time.

    Readings first shrink to one row per (station, pane), a pane being the widest cell that no
    window edge cuts; only panes are copied into their windows. Both steps aggregate before they
    shuffle, so a hot station costs no more than any other. On equal times the first arrival wins.

    ``arrival_replay`` withholds each reading from the windows already closed when it arrived;
    without it every reading counts, as for data known to be punctual.
    """
    size, slide = config.rising_window_ms, config.rising_slide_ms
    pane_ms = math.gcd(size, slide)
    if arrival_replay:
        settled, clocked = _split_by_clock(readings, config, chunk_rows)
    else:
        settled, clocked = readings.withColumn("ms", epoch_ms("observed_at")), None
    used = ["station_id", "seq", "ms", "water_level_m"]
    unclocked = settled.select(*used, F.lit(None).cast("long").alias("prev_max_ms"))
    if clocked is None:
        clocked = unclocked
    else:
        clocked = unclocked.unionByName(clocked.select(*used, "prev_max_ms"))
    pane = floor_to(F.col("ms"), pane_ms)
    first, last = _window_starts(F.col("pane"), config)
    panes = (
        clocked.filter(F.col("water_level_m").isNotNull())
        .withColumn("pane", pane)
        .withColumn("open_from", _first_open(first, config))
        .filter(F.col("open_from") <= last)
        .groupBy("station_id", "pane", "open_from")
        .agg(*boundary_readings(F.col("ms")))
    )
    windows = (
        panes.withColumn("start", F.explode(F.sequence("open_from", last, F.lit(slide).cast("long"))))
        .groupBy("station_id", "start")
        .agg(*_boundaries(*map(F.col, (
            "earliest_key", "latest_key", "earliest_ms", "latest_ms", "earliest_level_m", "latest_level_m"))))
    )
    return two_point_windows(windows, F.col("start"), F.col("start") + size)


def two_point_windows(windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Windows with readings at two different times, flattened, with the rise between them."""
    return windows.filter(F.col("earliest_ms") < F.col("latest_ms")).select(
        "station_id",
        start.alias("window_start_ms"),
        end.alias("window_end_ms"),
        "earliest_ms",
        "earliest_level_m",
        "latest_ms",
        "latest_level_m",
        (F.col("latest_level_m") - F.col("earliest_level_m")).alias("rise_m"),
    )


def rising_candidates(windows: DataFrame, config: RuleConfig) -> DataFrame:
    """Windows whose rise reaches the threshold; arrival order of the rule is the window end."""
    fired = windows.filter(F.col("rise_m") >= F.lit(config.rising_m)).withColumn(
        "seq", F.col("window_end_ms")
    )
    at = {
        name: iso_instant(F.timestamp_millis(f"{name}_ms"))
        for name in ("window_start", "window_end", "earliest", "latest")
    }
    threshold = F.lit(config.rising_m)
    reason = F.format_string(
        "Water level rose %.2fm within window %s to %s (>= %.2fm threshold)",
        F.col("rise_m"), at["window_start"], at["window_end"], threshold,
    )
    evidence = json_object(
        stationId=F.col("station_id"),
        eventTimestamp=at["latest"],
        windowStart=at["window_start"],
        windowEnd=at["window_end"],
        earliestWaterLevelM=F.col("earliest_level_m"),
        earliestObservedAt=at["earliest"],
        latestWaterLevelM=F.col("latest_level_m"),
        latestObservedAt=at["latest"],
        riseM=F.col("rise_m"),
        thresholdM=threshold,
    )
    return as_candidates(
        fired, LEVEL_RISING_FAST, reason, evidence, F.timestamp_millis("latest_ms")
    )
