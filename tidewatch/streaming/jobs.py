"""The streaming topology and its sinks.

raw topic -> ingest (decode, station check, first arrival) -> measurement table + measurements topic
measurements topic -> rules -> suppression -> alerts topic
alerts topic (+ operator commands) -> alert table

Each job is one query with a fixed name and its own checkpoint folder; a restart resumes from it.
Names and the order of stateful operators must not change between releases.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import RuleConfig
from tidewatch.functions.expr import epoch_ms, truncate_ms
from tidewatch.operators import ingest
from tidewatch.operators.arrival import KEY_CHUNK_ROWS
from tidewatch.operators.contracts import submission_errors
from tidewatch.operators.rising import (
    boundary_readings,
    flag_late,
    rising_candidates,
    two_point_windows,
)
from tidewatch.operators.rules import as_candidates, threshold_candidates
from tidewatch.operators.spike import spike_texts
from tidewatch.operators.stale import stale_texts
from tidewatch.operators.stored import STORED, store
from tidewatch.operators.suppression import (
    OPEN_RUNS,
    alert_events_of,
    as_alert_events,
    runs_left_open,
    tracked_runs,
)
from tidewatch.schemas import ALERT_FIELDS, COMMAND, SENSOR_SPIKE
from tidewatch.session import ROCKSDB, held, shared_dir
from tidewatch.sources.decode import decode_alert_events, decode_measurements, malformed, valid
from tidewatch.sources.topics import batch_name
from tidewatch.sources.wire import encode_alert_events, encode_measurements
from tidewatch.streaming.alert_table import AlertTable
from tidewatch.streaming.kept import KeptView
from tidewatch.streaming.processors import (
    ARRIVAL,
    NEW_ID,
    RUN_FACT,
    STATION_FACT,
    STORED_ID,
    KnownStation,
    RunState,
    StationState,
    first_arrivals,
)

CHECKPOINT_EVERY = "30 seconds"
MALFORMED = "MALFORMED"
#: groups that the event ids of a micro-batch are dealt to
ID_GROUPS = 4096


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state outgrows executor heaps; keep it in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def start(
    name: str,
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    use_rocksdb(stream.sparkSession)
    return (
        stream.writeStream.queryName(name)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": CHECKPOINT_EVERY}))
        .foreachBatch(sink)
        .start()
    )


# ---- ingest

def station_changes(raw: DataFrame) -> DataFrame:
    """Registered station ids off a topic of JSON station records; what has no id is left out."""
    station = F.from_json("value", "id string")
    return raw.select(station["id"].alias("station_id"), "seq").filter("station_id IS NOT NULL")


def with_known_station(
    decoded: DataFrame, stations: DataFrame, registered: DataFrame | None, shares: int
) -> DataFrame:
    """Add ``known``: whether the reading's station is registered by now.

    ``stations`` are those at the first ever start. Without ``registered`` that is all there are. With it, a stream of
    ``station_id`` registered since, every station has its mark in keyed state: registrations of a micro-batch
    come before its readings. A station's readings are dealt to ``shares`` keys by arrival number, each with a
    mark of its own, so that a station with most of the readings does not meet in one task.
    """
    ids = stations.select(F.col("id").alias("station_id")).distinct()
    if registered is None:
        known = ids.withColumn("known", F.lit(True))
        return decoded.join(known, "station_id", "left").select(
            *decoded.columns, F.col("known").isNotNull().alias("known"))
    every = F.explode(F.array(*[F.lit(k).cast("long") for k in range(shares)])).alias("share")
    record = F.struct(*decoded.columns)
    nothing = F.lit(None).cast(decoded.select(record.alias("r")).schema["r"].dataType)
    rows = decoded.select("station_id", F.pmod("seq", F.lit(shares)).alias("share"), record.alias("reading"))
    marks = registered.select("station_id", every, nothing.alias("reading"))
    schema = rows.select("reading", F.lit(True).alias("known")).schema
    return (
        rows.unionByName(marks)
        .groupBy("station_id", "share")
        .transformWithState(KnownStation(), schema, "append", "none", ids.select("station_id", every).groupBy("station_id", "share"))
        .select("reading.*", "known")
    )


def with_duplicates(arrivals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``duplicate``: whether the event id is that of an earlier arrival or of a reading in ``stored``.

    ``dropDuplicates`` keeps the ids in the state store and lets through those it meets for the first time. They join the
    arrivals of the micro-batch in groups of ids, where the first arrival of a new id is told from the others. The
    ids of ``stored`` are written to the shared folder, where they have to stay until the first batch is done, and
    come in as a stream that this batch reads whole.
    """
    ids, parts = arrivals.select("event_id"), [arrivals.withColumn("_kind", F.lit(ARRIVAL))]
    if stored is not None:
        spark = arrivals.sparkSession
        folder = f"{shared_dir(spark)}/stored-ids-{uuid.uuid4().hex}"
        stored.select("event_id").where("event_id IS NOT NULL").distinct().write.parquet(folder)
        taken = spark.readStream.schema("event_id string").parquet(folder)
        ids = ids.unionByName(taken)
        parts.append(taken.withColumn("_kind", F.lit(STORED_ID)))
    parts.append(ids.dropDuplicates(["event_id"]).withColumn("_kind", F.lit(NEW_ID)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.select(*arrivals.columns, "_kind")
    schema = arrivals.withColumn("duplicate", F.lit(False)).schema
    return rows.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(ID_GROUPS))).applyInArrow(first_arrivals, schema)


def labelled_submissions(
    raw: DataFrame, stations: DataFrame, check_uuid: bool = True, registered: DataFrame | None = None,
    shares: int = 8, stored: DataFrame | None = None,
) -> DataFrame:
    """Every raw record with its outcome: MALFORMED, ERROR, ACCEPTED or DUPLICATE.

    ``registered``: stations that register while the stream runs, see ``with_known_station``.

    Event ids are remembered for good in the state store, since an id may come again at any time: a lookup costs
    the same however long the history, where an anti-join with the stored table would read all of it for every
    micro-batch. ``stored``: readings stored by earlier runs; their ids are taken in once, when the query starts.
    """
    decoded = decode_measurements(raw, check_uuid=check_uuid).withColumn(
        "observed_at", truncate_ms(F.col("observed_at"))
    )
    checked = with_known_station(
        decoded.withColumn("invalid", F.size(submission_errors()) > 0), stations, registered, shares)
    sound = F.col("error").isNull() & ~F.col("invalid") & F.col("known")
    judged = with_duplicates(checked.filter(sound), stored)
    turned_away = checked.filter(~sound).withColumn("duplicate", F.lit(False))
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit(MALFORMED))
        .when(F.col("invalid") | ~F.col("known"), F.lit(ingest.ERROR))
        .when(F.col("duplicate"), F.lit(ingest.DUPLICATE))
        .otherwise(F.lit(ingest.ACCEPTED))
    )
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("invalid"), F.lit(ingest.MESSAGES["invalid"]))
        .when(~F.col("known"), F.lit(ingest.MESSAGES["unknown"]))
        .when(F.col("duplicate"), F.lit(ingest.MESSAGES["duplicate"]))
        .otherwise(F.lit(ingest.MESSAGES["accepted"]))
    )
    return (
        judged.unionByName(turned_away)
        .withColumns({"outcome": outcome, "message": message})
        .drop("invalid", "known", "duplicate")
    )


def ingest_sink(
    base: str,
    config: RuleConfig,
    publish: Callable[[DataFrame, int], None],
    kept: Sequence[KeptView] = (),
) -> Callable[[DataFrame, int], None]:
    """Write one labelled batch: quarantine, audit, measurement table, late rows, topic.

    All outputs go to folders named by run and batch, so a repeated batch replaces its own rows and a run
    under a new checkpoint adds to what earlier runs left. The measurement table lies by date first, its
    rows in order of station. ``kept``: views that take in the accepted readings, as of ``last_seen_view``.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch.sparkSession, batch_id)
        # several writes from one stateful result
        with held(batch, "ingest-batch") as rows:
            part = f"batch={name}"
            bad = rows.filter(F.col("outcome") == MALFORMED).drop("outcome", "message")
            malformed(bad).write.mode("overwrite").parquet(f"{base}/quarantine/{part}")
            rows.select("seq", "event_id", "station_id", "outcome", "message").write.mode(
                "overwrite"
            ).parquet(f"{base}/audit/{part}")
            accepted = rows.filter(F.col("outcome") == ingest.ACCEPTED)
            seen = Observation()
            store(accepted.observe(seen, F.max(epoch_ms("observed_at")).alias("max_ms")), f"{base}/measurements", name)
            _route_late(batch.sparkSession, accepted, base, batch_id, config, seen.get.get("max_ms"))
            for view in kept:
                view.add(accepted, name)
            publish(encode_measurements(accepted, keep=["seq", "received_at"]), batch_id)

    return sink


def _route_late(
    spark: SparkSession, accepted: DataFrame, base: str, batch_id: int, config: RuleConfig, highest: int | None
) -> None:
    """Side output of readings behind every open window, judged against the run's batches before.

    The ledger holds one number per batch: the highest event time up to and including it; ``highest`` is the
    batch's own, taken in the pass that wrote it.
    """
    previous = _ledger(spark, base, batch_id - 1)
    name = batch_name(spark, batch_id)
    late = accepted.filter(flag_late(F.lit(previous).cast("long"), config))
    late.select(*STORED).write.mode("overwrite").parquet(f"{base}/late/batch={name}")
    upto = max((ms for ms in (highest, previous) if ms is not None), default=None)
    spark.createDataFrame([(upto,)], "max_ms long").coalesce(1).write.mode("overwrite").parquet(f"{base}/ledger/batch={name}")


def _ledger(spark: SparkSession, base: str, batch_id: int) -> int | None:
    if batch_id < 0:
        return None
    rows = spark.read.schema("max_ms long").parquet(f"{base}/ledger/batch={batch_name(spark, batch_id)}").head(1)
    return rows[0].max_ms if rows else None


# ---- rules and suppression

def measurement_stream(raw: DataFrame, check_uuid: bool = True) -> DataFrame:
    """Valid readings of the measurements topic."""
    decoded = decode_measurements(raw, check_uuid=check_uuid)
    return valid(decoded).withColumn("observed_at", truncate_ms(F.col("observed_at")))


def alert_stream(readings: DataFrame, config: RuleConfig) -> DataFrame:
    """Alert events of a stream of valid readings.

    Threshold rules stay narrow and the rise aggregates partially before its shuffle; only the
    baseline, the silence timer and the run counter are keyed state. Late readings miss the rise
    windows alone: the keyed operators run without event-time eviction.
    """
    return suppress_stream(candidate_stream(readings, config), config)


def candidate_stream(readings: DataFrame, config: RuleConfig) -> DataFrame:
    """Candidates of all rules off a stream of valid readings, before suppression."""
    timed = with_event_time(readings, config)
    facts = (
        timed.select("station_id", "seq", "water_level_m", epoch_ms("observed_at").alias("event_ms"))
        .groupBy("station_id")
        .transformWithState(StationState(config), STATION_FACT, "append", "processingTime")
    )
    spiking = F.col("rule_code") == SENSOR_SPIKE
    texts = zip(spike_texts(config), stale_texts(config), strict=True)
    reason, evidence = (F.when(spiking, spike).otherwise(stale) for spike, stale in texts)
    station_rules = as_candidates(
        facts, F.col("rule_code"), reason, evidence, F.timestamp_millis("event_ms")
    )

    return (
        threshold_candidates(timed, config)
        .unionByName(station_rules)
        .unionByName(rising_stream(timed, config))
    )


def with_event_time(readings: DataFrame, config: RuleConfig) -> DataFrame:
    """Bounded disorder on event time, declared before any reading is filtered away."""
    return readings.withWatermark("observed_at", f"{config.watermark_min} minutes")


def rising_stream(timed: DataFrame, config: RuleConfig) -> DataFrame:
    """Candidates of the rise rule, once per closed window; state is two readings per window."""
    window = F.window(
        "observed_at", f"{config.rising_window_min} minutes", f"{config.rising_slide_min} minutes"
    )
    windows = (
        timed.filter(F.col("water_level_m").isNotNull())
        .groupBy("station_id", window.alias("window"))
        .agg(*boundary_readings(epoch_ms("observed_at")))
    )
    return rising_candidates(
        two_point_windows(windows, epoch_ms("window.start"), epoch_ms("window.end")), config
    )


def suppress_stream(candidates: DataFrame, config: RuleConfig) -> DataFrame:
    """Alert events of a candidate stream: the keyed form of ``operators.suppression``."""
    runs = (
        candidates.withColumn("event_ms", epoch_ms(F.coalesce("event_time", F.current_timestamp())))
        .drop("event_time")
        .groupBy("station_id", "rule_code")
        .transformWithStateInPandas(RunState(config), RUN_FACT, "append", "none")
    )
    return as_alert_events(
        runs, F.col("first_seq"), F.col("triggered_ms"), F.col("event_ms"), F.col("repeat_count")
    )


def suppression_sink(
    base: str, config: RuleConfig, publish: Callable[[DataFrame, int], None], chunk_rows: int = KEY_CHUNK_ROWS
) -> Callable[[DataFrame, int], None]:
    """Suppress a micro-batch of candidates in the batch operator's chunks, for conditions too hot for one task.

    ``suppress_stream`` keeps the open run of a key as state and walks the key's rows in one task. Here the open
    runs are a relation of one row per key, written for every batch from the one before; a key's rows of a batch are dealt
    by chunk. A repeated batch starts from the same relation again and replaces what it wrote.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], OPEN_RUNS)
        if batch_id > 0:
            before = spark.read.schema(OPEN_RUNS).parquet(f"{base}/open_runs/batch={batch_name(spark, batch_id - 1)}")
        with held(batch, "candidates") as candidates:
            with held(tracked_runs(candidates, config, chunk_rows, before), "tracked-runs") as tracked:
                publish(alert_events_of(tracked), batch_id)
                runs_left_open(tracked, before).write.mode("overwrite").parquet(
                    f"{base}/open_runs/batch={batch_name(spark, batch_id)}")

    return sink


def alert_sink(publish: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, batch_id: int) -> None:
        records = encode_alert_events(batch, keep=["seq"])
        publish(records.withColumn("received_at", F.current_timestamp()), batch_id)

    return sink


# ---- persistence

def persistence_stream(alerts_raw: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Alert records and operator commands as one stream: the alert table has a single writer."""
    events = alerts_raw.select("seq", F.lit("event").alias("kind"), "value")
    if commands is None:
        return events
    return events.unionByName(commands.select("seq", F.lit("command").alias("kind"), "value"))


def persistence_sink(
    table: AlertTable, stations: Callable[[], DataFrame], base: str, check_uuid: bool = True
) -> Callable[[DataFrame, int], None]:
    """Apply a batch's events, then its commands; whatever is turned away goes to audit folders."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch.sparkSession, batch_id)
        part = f"batch={name}"
        # records are decoded once, for all outputs
        decoded = decode_alert_events(batch.filter(F.col("kind") == "event"), check_uuid=check_uuid)
        raw = batch.filter(F.col("kind") == "command")
        document = F.try_parse_json("value")
        is_object = F.coalesce(F.call_function("schema_of_variant", document).startswith("OBJECT"), F.lit(False))
        commands = raw.select(
            F.from_json("value", COMMAND.replace(", seq long", "")).alias("c"), "seq", "value", is_object.alias("sound"))
        with held(decoded, "alert-batch") as alerts, held(commands, "command-batch") as asked:
            events = alerts.filter(F.col("error").isNull()).select(*ALERT_FIELDS, "seq")
            undecodable = alerts.filter(F.col("error").isNotNull()).select("seq", "error", "value")
            undecodable.write.mode("overwrite").parquet(f"{base}/alert_quarantine/{part}")
            asked.filter(~F.col("sound")).select("seq", "value").write.mode("overwrite").parquet(
                f"{base}/command_quarantine/{part}")
            table.apply(
                batch_id, events, stations(), asked.filter("sound").select("c.*", "seq"),
                lambda verdicts: verdicts.write.mode("overwrite").parquet(f"{base}/command_audit/{part}"),
                run=name.rpartition("-")[0],
                rejects=lambda events: events.write.mode("overwrite").parquet(f"{base}/alert_rejects/{part}"),
            )

    return sink
