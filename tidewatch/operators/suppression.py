"""Repeat suppression: runs of one condition become one alert with a counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.functions.expr import epoch_ms, stable_uuid, with_json_entry
from tidewatch.operators.arrival import KEY_CHUNK_ROWS, chunk_of
from tidewatch.schemas import ACTIVE, ALERT_FIELDS, LEVEL_RISING_FAST, STATION_STALE

KEY = ["station_id", "rule_code"]


def alert_id(station: Column, rule: Column, first_seq: Column) -> Column:
    """Same run, same id, on every replay: the digest of the key and the run's first arrival."""
    return stable_uuid(station, rule, first_seq.cast("string"))


OPEN_RUNS = (
    "station_id string, rule_code string, first_seq long, triggered_ms long, last_ms long, repeat_count int"
)
# the number of the chunk that stands for earlier batches
BEFORE_ALL = -(1 << 62)


def as_alert_events(
    candidates: DataFrame, first_seq: Column, triggered_ms: Column, last_ms: Column, repeat: Column
) -> DataFrame:
    """Candidates with their run attached, as alert events."""
    return candidates.select(
        alert_id(F.col("station_id"), F.col("rule_code"), first_seq).alias("id"),
        "station_id", "rule_code", "severity",
        F.lit(ACTIVE).alias("status"),
        "title", "reason",
        with_json_entry(F.col("evidence"), "repeatCount", repeat).alias("evidence"),
        F.timestamp_millis(triggered_ms).alias("triggered_at"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.timestamp_millis(last_ms).alias("last_occurred_at"),
        repeat.alias("repeat_count"),
        "seq",
    ).select(*ALERT_FIELDS, "seq")


def suppress(
    candidates: DataFrame, config: RuleConfig, chunk_rows: int = KEY_CHUNK_ROWS, open_runs: DataFrame | None = None
) -> DataFrame:
    """Every candidate as an alert event carrying its run's id, start and repeat count; see ``tracked_runs``."""
    tracked = tracked_runs(candidates, config, chunk_rows, open_runs)
    return alert_events_of(tracked)


def alert_events_of(tracked: DataFrame) -> DataFrame:
    """Alert events of candidates with their runs."""
    return as_alert_events(tracked, F.col("first_seq"), F.col("triggered_ms"), F.col("last_ms"), F.col("repeat_count"))


def runs_left_open(tracked: DataFrame, open_runs: DataFrame) -> DataFrame:
    """The run every key is in after a batch: ``open_runs`` for the next one."""
    last = F.max_by(F.struct("first_seq", "triggered_ms", "last_ms", "repeat_count"), "seq").alias("run")
    now = tracked.groupBy(*KEY).agg(last).select(*KEY, "run.*")
    return now.unionByName(open_runs.join(now, KEY, "left_anti"))


def tracked_runs(
    candidates: DataFrame, config: RuleConfig, chunk_rows: int = KEY_CHUNK_ROWS, open_runs: DataFrame | None = None
) -> DataFrame:
    """Candidates with the run they belong to: ``first_seq``, ``triggered_ms``, ``last_ms`` and ``repeat_count``.

    ``open_runs`` (one row per key, ``OPEN_RUNS``): where earlier arrivals left each key. To the scan along a
    key it is one more chunk summary, ahead of all others.

    A candidate repeats its predecessor (in arrival order, per station and rule) when its event
    time is less than the suppression window after the predecessor's, also when it is earlier;
    otherwise it opens a new run. The window slides with every occurrence.

    Keys are cut into chunks of arrival order. Within a chunk the run of a row is known except for
    the rows ahead of its first opening; a summary per chunk (count, first and last time, last
    opening) is scanned along the key and gives each chunk the run it starts in. A hot condition so
    spreads over all tasks, and rows are shuffled once; give it a materialised input, the rows are
    read by two branches. Time-ordered rules fire at most once per slide or timeout, which bounds
    their chunks as the row count bounds the others.
    """
    time_width = {
        LEVEL_RISING_FAST: chunk_rows * config.rising_slide_ms,
        STATION_STALE: chunk_rows * config.stale_ms,
    }
    rule, seq = F.col("rule_code"), F.col("seq")
    chunk = F.when(rule == LEVEL_RISING_FAST, chunk_of(seq, time_width[LEVEL_RISING_FAST])).when(
        rule == STATION_STALE, chunk_of(seq, time_width[STATION_STALE])
    ).otherwise(chunk_of(seq, chunk_rows))

    local = Window.partitionBy(*KEY, "_chunk").orderBy("seq")
    rows = (
        candidates.withColumns({
            "_chunk": chunk, "_ms": epoch_ms(F.coalesce("event_time", F.current_timestamp())),
        })
        .withColumns({"_gap": F.col("_ms") - F.lag("_ms").over(local), "_pos": F.row_number().over(local)})
        # null gap: the predecessor, if any, is in an earlier chunk
        .withColumn("_opens", F.col("_gap") >= config.suppression_ms)
        .withColumn(
            "_run",
            F.last(
                F.when(F.col("_opens"), F.struct(F.col("_pos").cast("long").alias("pos"), "_ms", "seq")),
                ignorenulls=True,
            ).over(local.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )

    along = Window.partitionBy(*KEY).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_pos") == 1
    opened = F.col("_first_opens")
    offset = F.col("_offset")
    chunks = (
        rows.groupBy(*KEY, "_chunk")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max(F.when(first, F.col("_ms"))).alias("_first_ms"),
            F.max(F.when(first, F.col("seq"))).alias("_first_seq"),
            F.max_by("_ms", "_pos").alias("_last_ms"),
            F.max("_run").alias("_last_run"),
        )
    )
    if open_runs is not None:
        # a chunk of the rows of the open run alone, which begins with its first arrival
        chunks = chunks.unionByName(open_runs.select(
            *KEY, F.lit(BEFORE_ALL).alias("_chunk"), F.col("repeat_count").cast("long").alias("_rows"),
            F.col("triggered_ms").alias("_first_ms"), F.col("first_seq").alias("_first_seq"),
            F.col("last_ms").alias("_last_ms"), F.lit(None).cast(chunks.schema["_last_run"].dataType).alias("_last_run")))
    chunks = (
        chunks.withColumns({
            "_first_opens": F.coalesce(
                F.col("_first_ms") - F.lag("_last_ms").over(along) >= config.suppression_ms, F.lit(True)
            ),
            "_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        })
        # positions counted along the whole key from here on
        .withColumn(
            "_own_first",
            F.when(opened, F.struct(
                (offset + 1).alias("pos"), F.col("_first_ms").alias("_ms"), F.col("_first_seq").alias("seq")
            )),
        )
        .withColumn(
            "_open_at_end",
            F.coalesce(
                F.when(F.col("_last_run").isNotNull(), F.struct(
                    (offset + F.col("_last_run.pos")).alias("pos"),
                    F.col("_last_run._ms").alias("_ms"),
                    F.col("_last_run.seq").alias("seq"),
                )),
                F.col("_own_first"),
            ),
        )
        .withColumn(
            "_starts_in",
            F.coalesce(F.col("_own_first"), F.last("_open_at_end", ignorenulls=True).over(earlier)),
        )
        .select(*KEY, "_chunk", "_offset", "_starts_in")
    )

    joined = rows.join(chunks, [*KEY, "_chunk"])
    own = F.col("_run").isNotNull()
    run_pos = F.when(own, offset + F.col("_run.pos")).otherwise(F.col("_starts_in.pos"))
    run_ms = F.when(own, F.col("_run._ms")).otherwise(F.col("_starts_in._ms"))
    run_seq = F.when(own, F.col("_run.seq")).otherwise(F.col("_starts_in.seq"))
    repeat = (offset + F.col("_pos") - run_pos + 1).cast("int")
    return joined.select(
        *candidates.columns, run_seq.alias("first_seq"), run_ms.alias("triggered_ms"),
        F.col("_ms").alias("last_ms"), repeat.alias("repeat_count"))
