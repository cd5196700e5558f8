"""Registered queries over the star-schema test tables, one per operator.

Times leave as epoch milliseconds so that results do not depend on time-zone rendering.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.functions.expr import epoch_ms, parse_severity
from tidewatch.operators import alerts as al
from tidewatch.operators import ingest, stored, views
from tidewatch.operators import stations as st
from tidewatch.operators.contracts import with_submission_errors
from tidewatch.operators.rising import late_readings, rising_candidates, rising_windows
from tidewatch.operators.rules import level_and_rain, level_high, rain_intense, threshold_candidates
from tidewatch.operators.spike import spike_baseline, spikes
from tidewatch.operators.stale import last_observed, stale_gaps
from tidewatch.operators.suppression import suppress
from tidewatch.plans.replay import alert_events, alert_table, all_candidates
from tidewatch.session import materialize, prepare, shared_dir
from tidewatch.sources.decode import decode_alert_events, decode_measurements, malformed
from tidewatch.sources.events import bad_clocks, event_stream, measurements, read_table, scrambled, stations
from tidewatch.sources.topics import read_folder
from tidewatch.sources.wire import encode_alert_events, encode_measurements, to_wire_event
from tidewatch.streaming import jobs
from tidewatch.streaming.alert_table import AlertTable
from tidewatch.streaming.kept import last_seen_view, latest_view

CONFIG = RuleConfig()
# fields of the evidence objects of all rules
EVIDENCE = (
    "stationId string, eventTimestamp string, lastObservedAt string, waterLevelM double, rainfallMmPerHour double,"
    " thresholdM double, thresholdMmPerHour double, levelThresholdM double, rainThresholdMmPerHour double,"
    " windowStart string, windowEnd string, earliestObservedAt string, latestObservedAt string,"
    " earliestWaterLevelM double, latestWaterLevelM double, riseM double, deltaM double, baselineMedianM double,"
    " baselineSampleCount int, staleTimeoutMinutes int"
)
STATION = "3"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register a function under ``name``, with the session settings in place."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        return fn

    return register


def ms(column: str, name: str) -> Column:
    return epoch_ms(column).alias(name)


def slim_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "station_id", "rule_code", "severity", "title", ms("event_time", "event_ms"), "seq"
    )


def clock_end(spark: SparkSession, sf: str) -> Column:
    """The replay clock stops at the last receive time in the data."""
    return measurements(spark, sf).agg(F.max("received_at")).scalar()


# ---- rules on single readings

@query("threshold_candidates")
def q_threshold_candidates(spark, sf):
    return slim_candidates(threshold_candidates(measurements(spark, sf), CONFIG))


def _fired(spark, sf, condition):
    return measurements(spark, sf).filter(condition).select(
        "event_id", "station_id", ms("observed_at", "event_ms"), "water_level_m", "rainfall_mm_per_hour"
    )


@query("level_high")
def q_level_high(spark, sf):
    return _fired(spark, sf, level_high(CONFIG))


@query("rain_intense")
def q_rain_intense(spark, sf):
    return _fired(spark, sf, rain_intense(CONFIG))


@query("level_and_rain")
def q_level_and_rain(spark, sf):
    return _fired(spark, sf, level_and_rain(CONFIG))


# ---- ingest

def raw_measurements(m: DataFrame) -> DataFrame:
    """Every reading as JSON text, thirteen kinds of payload by arrival number."""
    kind = F.col("seq") % 13

    def entry(name: str, value: Column, missing: int) -> Column:
        return F.when(kind == missing, F.lit("")).otherwise(F.concat(F.lit(f'"{name}":'), value, F.lit(",")))

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    level = (
        F.when(kind == 7, F.lit("-1.0"))
        .when(kind == 9, F.lit('{"a":1}'))
        .when(kind == 11, F.lit('"2.5"'))
        .otherwise(F.col("water_level_m").cast("string"))
    )
    rain = F.when(kind == 8, F.lit("-2")).otherwise(F.col("rainfall_mm_per_hour").cast("string"))
    body = F.concat(
        F.lit("{"),
        entry("eventId", quoted(F.col("event_id")), 3),
        entry("stationId", quoted(F.col("station_id")), 4),
        entry("observedAt", quoted(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), 5),
        entry("schemaVersion", F.lit("1"), 6),
        F.lit('"waterLevelM":'), level,
        F.lit(',"rainfallMmPerHour":'), rain,
        F.lit(',"note":{"x":[1,2]}}'),
    )
    value = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, F.lit("   "))
        .when(kind == 2, F.concat(F.lit("{not json"), body))
        .when(kind == 10, F.lit("[1,2]"))
        .otherwise(body)
    )
    return m.select("seq", "received_at", value.alias("value"))


@query("ingest_validation")
def q_ingest_validation(spark, sf):
    decoded = decode_measurements(raw_measurements(measurements(spark, sf)), check_uuid=False)
    sound = F.col("error").isNull()
    return decoded.select(
        "seq",
        F.coalesce("error", F.lit("valid")).alias("verdict"),
        F.when(sound, F.col("station_id")).alias("station_id"),
        F.when(sound, epoch_ms("observed_at")).alias("event_ms"),
        F.when(sound, F.col("water_level_m")).alias("water_level_m"),
        F.when(sound, F.col("rainfall_mm_per_hour")).alias("rainfall_mm_per_hour"),
    )


@query("malformed_by_error")
def q_malformed_by_error(spark, sf):
    decoded = decode_measurements(raw_measurements(measurements(spark, sf)), check_uuid=False)
    return decoded.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("malformed_records")
def q_malformed_records(spark, sf):
    """Quarantined records: the error, the head of the side record and whether a payload is kept."""
    bad = malformed(decode_measurements(raw_measurements(measurements(spark, sf)), check_uuid=False))
    head = F.substring_index("record", " | raw=", 1)
    return bad.select("seq", "error", head.alias("head"), F.col("raw").isNotNull().alias("has_raw"))


def submissions(spark, sf) -> DataFrame:
    """Every reading as a submission; some repeat an event id or break the contract."""
    seq = F.col("seq")
    number = seq - F.when(seq % 10 == 3, 1).when(seq % 10 == 8, 3).otherwise(0)
    return measurements(spark, sf).withColumns({
        "event_id": F.when(seq % 37 == 0, F.lit(" ")).otherwise(number.cast("string")),
        "water_level_m": F.when(seq % 17 == 0, F.lit(None)).when(seq % 23 == 0, F.lit(-1.0))
        .otherwise(F.col("water_level_m")),
        "rainfall_mm_per_hour": F.when(seq % 19 == 0, F.lit(-0.5)).otherwise(F.col("rainfall_mm_per_hour")),
        "schema_version": F.when(seq % 29 == 0, F.lit(0)).when(seq % 31 == 0, F.lit(None)).otherwise(F.lit(1)),
    })


@query("submission_errors")
def q_submission_errors(spark, sf):
    checked = with_submission_errors(submissions(spark, sf))
    pairs = F.transform(
        F.array_sort(F.map_keys("errors")), lambda k: F.concat(k, F.lit(": "), F.col("errors")[k])
    )
    return checked.select("seq", F.array_join(pairs, "; ").alias("errors"))


@query("dedup_first")
def q_dedup_first(spark, sf):
    copies = measurements(spark, sf).withColumn("event_id", F.call_function("div", F.col("seq"), F.lit(3)).cast("string"))
    return ingest.first_arrivals(copies).select(
        "event_id", "seq", "station_id", ms("observed_at", "event_ms"), "water_level_m"
    )


@query("unknown_station")
def q_unknown_station(spark, sf):
    rows = ingest.unknown_station(measurements(spark, sf), stations(spark, sf))
    return rows.select("event_id", "station_id", ms("observed_at", "event_ms"))


@query("known_station")
def q_known_station(spark, sf):
    rows = ingest.known_station(measurements(spark, sf), stations(spark, sf))
    return rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_outcomes")
def q_ingest_outcomes(spark, sf):
    return ingest.outcomes(submissions(spark, sf), stations(spark, sf)).select(
        "seq", "event_id", "outcome", "message"
    )


@query("stored_measurements")
def q_stored_measurements(spark, sf):
    labelled = ingest.outcomes(submissions(spark, sf), stations(spark, sf))
    return to_wire_event(ingest.accepted(labelled)).select(
        "event_id", "station_id", ms("observed_at", "event_ms"), "water_level_m",
        "rainfall_mm_per_hour", "schema_version",
    )


@query("wire_round_trip")
def q_wire_round_trip(spark, sf):
    sent = encode_measurements(to_wire_event(measurements(spark, sf)))
    return decode_measurements(sent, check_uuid=False).select(
        "key", "event_id", "station_id", ms("observed_at", "event_ms"), "water_level_m",
        "rainfall_mm_per_hour", "flow_rate_m3s", "schema_version", "error",
    )


@query("reading_output")
def q_reading_output(spark, sf):
    shown = views.reading_output(measurements(spark, sf))
    return shown.select(*[c for c in shown.columns if c != "observed_at"], ms("observed_at", "event_ms"))


# ---- event-time windows

def _windows(windows: DataFrame) -> DataFrame:
    return windows.select(
        "station_id", "window_start_ms", "window_end_ms", "earliest_ms", "earliest_level_m",
        "latest_ms", "latest_level_m", "rise_m",
    )


@query("rising_windows")
def q_rising_windows(spark, sf):
    return _windows(rising_windows(measurements(spark, sf), CONFIG))


@query("rising_windows_disordered")
def q_rising_windows_disordered(spark, sf):
    return _windows(rising_windows(scrambled(measurements(spark, sf)), CONFIG))


@query("rising_alert_candidates")
def q_rising_alert_candidates(spark, sf):
    return slim_candidates(rising_candidates(rising_windows(measurements(spark, sf), CONFIG), CONFIG))


@query("late_events")
def q_late_events(spark, sf):
    return late_readings(scrambled(measurements(spark, sf)), CONFIG).select(
        "event_id", "station_id", "ms", "prev_max_ms"
    )


# ---- keyed state

def _baseline(baseline: DataFrame) -> DataFrame:
    return baseline.select(
        "station_id", "seq", "event_ms", "level_m", "baseline_count", "baseline_median_m"
    )


@query("spike_baseline")
def q_spike_baseline(spark, sf):
    return _baseline(spike_baseline(measurements(spark, sf), CONFIG))


@query("spike_baseline_disordered")
def q_spike_baseline_disordered(spark, sf):
    return _baseline(spike_baseline(scrambled(measurements(spark, sf)), CONFIG))


@query("spike_baseline_bad_clock")
def q_spike_baseline_bad_clock(spark, sf):
    """Clocks that run ahead: what arrives later is old, and samples of the future stay for good."""
    return _baseline(spike_baseline(bad_clocks(scrambled(measurements(spark, sf))), CONFIG))


@query("spike_alerts")
def q_spike_alerts(spark, sf):
    return spikes(spike_baseline(measurements(spark, sf), CONFIG), CONFIG).select(
        "station_id", "seq", "event_ms", "level_m", "baseline_count", "baseline_median_m", "delta_m"
    )


@query("stale_alerts")
def q_stale_alerts(spark, sf):
    return stale_gaps(measurements(spark, sf), CONFIG, clock_end(spark, sf))


@query("last_observed")
def q_last_observed(spark, sf):
    return last_observed(scrambled(measurements(spark, sf))).select(
        "station_id", ms("last_observed_at", "last_observed_ms")
    )


@query("all_candidates")
def q_all_candidates(spark, sf):
    return slim_candidates(all_candidates(measurements(spark, sf), CONFIG, clock_end(spark, sf)))


@query("candidate_texts")
def q_candidate_texts(spark, sf):
    texts = all_candidates(measurements(spark, sf), CONFIG, clock_end(spark, sf))
    return texts.select(
        "station_id", "rule_code", "seq", "reason", F.from_json("evidence", EVIDENCE).alias("e")
    ).select(
        "station_id", "rule_code", "seq", "reason", F.col("e.stationId").alias("evidence_station"),
        F.coalesce("e.eventTimestamp", "e.lastObservedAt").alias("at"),
        F.col("e.waterLevelM").alias("water_level"), F.col("e.rainfallMmPerHour").alias("rainfall"),
        F.coalesce("e.thresholdM", "e.thresholdMmPerHour", "e.levelThresholdM").alias("threshold"),
        F.col("e.rainThresholdMmPerHour").alias("rain_threshold"),
        F.col("e.windowStart").alias("window_start"), F.col("e.windowEnd").alias("window_end"),
        F.col("e.earliestObservedAt").alias("earliest_at"), F.col("e.latestObservedAt").alias("latest_at"),
        F.col("e.earliestWaterLevelM").alias("earliest_level"), F.col("e.latestWaterLevelM").alias("latest_level"),
        F.coalesce("e.riseM", "e.deltaM").alias("change"), F.col("e.baselineMedianM").alias("median"),
        F.coalesce("e.baselineSampleCount", "e.staleTimeoutMinutes").alias("number"),
    )


def _events(spark, sf) -> DataFrame:
    return alert_events(measurements(spark, sf), CONFIG, clock_end(spark, sf))


def _alert_columns(alerts: DataFrame, *more: str) -> DataFrame:
    return alerts.select(
        "id", "station_id", "rule_code", "severity", "status", "title",
        ms("triggered_at", "triggered_ms"), ms("last_occurred_at", "last_occurred_ms"),
        "repeat_count", *more,
    )


@query("suppressed_alert_events")
def q_suppressed_alert_events(spark, sf):
    return _alert_columns(_events(spark, sf), "seq")


@query("alert_event_round_trip")
def q_alert_event_round_trip(spark, sf):
    sent = encode_alert_events(_events(spark, sf))
    back = decode_alert_events(sent, check_uuid=False)
    return _alert_columns(back, "key", "error")


@query("suppressed_disordered")
def q_suppressed_disordered(spark, sf):
    readings = scrambled(measurements(spark, sf))
    candidates = materialize(threshold_candidates(readings, CONFIG), "candidates")
    return _alert_columns(suppress(candidates, CONFIG), "seq")


# ---- streaming runs

def _run_stream(name: str, stream: DataFrame) -> DataFrame:
    """Run a stream over all input there is and read back what it wrote."""
    spark = jobs.use_rocksdb(stream.sparkSession)
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (
        stream.writeStream.queryName(name)
        .outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/out", format="parquet")
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_ingest")
def q_stream_ingest(spark, sf):
    """Raw payloads through the ingest stream; every id arrives twice, at different times."""
    readings = event_stream(spark, sf)
    pairs = readings.withColumn("event_id", F.call_function("div", F.col("seq"), F.lit(2)).cast("string"))
    labelled = jobs.labelled_submissions(raw_measurements(pairs), stations(spark, sf), check_uuid=False)
    return _run_stream("stream_ingest", labelled).select("seq", "outcome", "message")


@query("stream_threshold_alerts")
def q_stream_threshold_alerts(spark, sf):
    """Threshold rules and the keyed run state as a stream."""
    candidates = threshold_candidates(event_stream(spark, sf), CONFIG)
    return _alert_columns(_run_stream("stream_threshold_alerts", jobs.suppress_stream(candidates, CONFIG)), "seq")


@query("stream_suppressed_chunks")
def q_stream_suppressed_chunks(spark, sf):
    """Threshold rules in four micro-batches, suppressed chunk by chunk from the runs left open before."""
    jobs.use_rocksdb(spark)
    base = f"{shared_dir(spark)}/stream_suppressed_chunks-{uuid.uuid4().hex}"
    rows = measurements(spark, sf)
    quarter = rows.agg(F.call_function("div", F.max("seq"), F.lit(4)) + 1).first()[0]
    sink = jobs.suppression_sink(base, CONFIG, lambda events, batch: events.write.mode("overwrite").parquet(
        f"{base}/out/batch={batch}"), chunk_rows=1 << 12)
    for k in range(4):
        rows.filter(F.call_function("div", F.col("seq"), F.lit(quarter)) == k).write.parquet(f"{base}/in/part={k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*")
        jobs.start("stream_suppressed_chunks", threshold_candidates(stream, CONFIG), sink, f"{base}/checkpoint",
                   {"availableNow": True}).awaitTermination()
    return _alert_columns(spark.read.parquet(f"{base}/out"), "seq")


@query("stream_rising")
def q_stream_rising(spark, sf):
    """Rise windows as a stream: those the watermark has closed by the end of the data."""
    candidates = jobs.rising_stream(jobs.with_event_time(event_stream(spark, sf), CONFIG), CONFIG)
    return slim_candidates(_run_stream("stream_rising", candidates))


def _ingest(spark, sf, name: str, raw: DataFrame, *kept) -> str:
    """Run the ingest stream over ``raw`` with views to keep; returns its folder."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    labelled = jobs.labelled_submissions(raw, stations(spark, sf), check_uuid=False)
    views_ = [view(spark, f"{base}/{view.__name__}") for view in kept]
    sink = jobs.ingest_sink(base, CONFIG, lambda records, batch: None, views_)
    jobs.start(name, labelled, sink, f"{base}/checkpoint", {"availableNow": True}).awaitTermination()
    return base


def _published(readings: DataFrame) -> DataFrame:
    return encode_measurements(readings, keep=["seq", "received_at"])


@query("stream_station_cards")
def q_stream_station_cards(spark, sf):
    """Station cards from the view of latest readings that the ingest stream keeps."""
    base = _ingest(spark, sf, "stream_station_cards", _published(event_stream(spark, sf)), latest_view)
    latest = latest_view(spark, f"{base}/latest_view").read()
    return views.station_cards(stations(spark, sf), latest).select(
        "id", "name", ms("observed_at", "event_ms"), "reading")


@query("stream_last_seen")
def q_stream_last_seen(spark, sf):
    """Last-seen times that the ingest stream keeps, in disturbed arrival order."""
    base = _ingest(spark, sf, "stream_last_seen", _published(scrambled(event_stream(spark, sf))), last_seen_view)
    seen = last_seen_view(spark, f"{base}/last_seen_view").read()
    return st.with_last_seen(stations(spark, sf), seen).select("id", ms("last_seen_at", "last_seen_ms"))


@query("stream_live_stations")
def q_stream_live_stations(spark, sf):
    """Two runs of one ingest stream; every other station registers between them."""
    jobs.use_rocksdb(spark)
    base = f"{shared_dir(spark)}/stream_live_stations-{uuid.uuid4().hex}"
    readings = measurements(spark, sf)
    half = readings.agg(F.call_function("div", F.max("seq"), F.lit(2))).first()[0]
    early = F.col("id").cast("long") % 2 == 0
    record = F.to_json(F.struct("id")).alias("value")
    late = stations(spark, sf).filter(~early).select(
        F.col("id").cast("long").alias("seq"), F.col("id").alias("key"), record,
        F.current_timestamp().alias("received_at"))
    for run, (more, changes) in enumerate([("seq <= {}", late.limit(0)), ("seq > {}", late)]):
        _published(readings.filter(more.format(half))).write.json(f"{base}/raw/part={run}")
        changes.write.json(f"{base}/stations/part={run}")
        labelled = jobs.labelled_submissions(
            read_folder(spark, f"{base}/raw/*"), stations(spark, sf).filter(early), check_uuid=False,
            registered=jobs.station_changes(read_folder(spark, f"{base}/stations/*")))
        (
            labelled.select("seq", "outcome", "message").writeStream.queryName("stream_live_stations").outputMode("append")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
            .start(f"{base}/out", format="parquet").awaitTermination()
        )
    return spark.read.schema("seq long, outcome string, message string").parquet(f"{base}/out")


@query("stream_ingest_again")
def q_stream_ingest_again(spark, sf):
    """A new checkpoint over a table that holds every third reading already."""
    stored = measurements(spark, sf).filter("seq % 3 = 0")
    labelled = jobs.labelled_submissions(
        _published(event_stream(spark, sf)), stations(spark, sf), check_uuid=False, stored=stored)
    return _run_stream("stream_ingest_again", labelled).select("seq", "outcome", "message")


# ---- the stored table

def _stored(spark, sf) -> str:
    path = f"{shared_dir(spark)}/measurements-{uuid.uuid4().hex}"
    stored.store(measurements(spark, sf), path, "replay")
    return path


@query("stored_recent_100")
def q_stored_recent_100(spark, sf):
    return _reading(stored.recent(spark, _stored(spark, sf)))


@query("stored_recent_50_of_station")
def q_stored_recent_50_of_station(spark, sf):
    return _reading(stored.recent_of_station(spark, _stored(spark, sf), STATION))


@query("stored_between")
def q_stored_between(spark, sf):
    return _reading(stored.between(spark, _stored(spark, sf), "2024-01-05", "2024-01-07"))


# ---- the alert table

def _table(spark, sf) -> DataFrame:
    return alert_table(_events(spark, sf), stations(spark, sf))


@query("alerts_current")
def q_alerts_current(spark, sf):
    return _alert_columns(_table(spark, sf))


@query("alerts_rejected")
def q_alerts_rejected(spark, sf):
    screened = al.screen_events(_events(spark, sf), stations(spark, sf))
    return al.rejected(screened).select("id", "station_id", "rule_code", "seq", "reject_reason")


@query("alerts_redelivered")
def q_alerts_redelivered(spark, sf):
    """Persist everything, then receive the same events again: nothing may change."""
    events = materialize(_events(spark, sf), "events")
    table = alert_table(events, stations(spark, sf))
    return _alert_columns(alert_table(events, stations(spark, sf), table))


@query("stream_alert_table")
def q_stream_alert_table(spark, sf):
    """Alert records and operator commands through the persistence stream into the stored table."""
    base = f"{shared_dir(spark)}/stream_alert_table-{uuid.uuid4().hex}"
    now = F.current_timestamp().alias("received_at")
    events = materialize(_events(spark, sf), "events")
    encode_alert_events(events, keep=["seq"]).select("*", now).write.json(f"{base}/alerts")
    asked = commands_for(alert_table(events, stations(spark, sf)))
    record = F.to_json(F.struct("alert_id", "action", "at", "note")).alias("value")
    asked.select("seq", F.col("alert_id").alias("key"), record, now).write.json(f"{base}/commands")
    stream = jobs.persistence_stream(read_folder(spark, f"{base}/alerts"), read_folder(spark, f"{base}/commands"))
    table = AlertTable(spark, f"{base}/table")
    sink = jobs.persistence_sink(table, lambda: stations(spark, sf), base, check_uuid=False)
    jobs.start("stream_alert_table", stream, sink, f"{base}/checkpoint", {"availableNow": True}).awaitTermination()
    return table.read().select(
        "id", "status", ms("acknowledged_at", "acknowledged_ms"), ms("resolved_at", "resolved_ms"))


@query("alert_by_id")
def q_alert_by_id(spark, sf):
    """The alert with the smallest id, looked up by it."""
    table = materialize(_table(spark, sf), "alerts")
    return _alert_columns(views.alert_by_id(table, table.agg(F.min("id")).scalar()))


@query("alerts_insert")
def q_alerts_insert(spark, sf):
    """Alerts of some stations, added as they are to a table that holds the others."""
    table = materialize(_table(spark, sf), "alerts")
    some = F.col("station_id").cast("int") % 2 == 0
    return _alert_columns(al.insert(table.filter(~some), table.filter(some)))


@query("severity_parse")
def q_severity_parse(spark, sf):
    raw = (
        F.when(F.col("event_type") == "error", F.lit("critical"))
        .when(F.col("event_type") == "click", F.lit("High"))
        .when(F.col("event_type") == "view", F.lit("  "))
        .when(F.col("event_type") == "purchase", F.lit(None))
        .otherwise(F.col("event_type"))
    )
    return read_table(spark, sf, "events").select("event_id", parse_severity(raw).alias("severity"))


def commands_for(alerts: DataFrame) -> DataFrame:
    """Operator commands of five patterns, chosen by the alert's trigger time."""
    def command(action: str, delay: int, n: int, suffix: str = "") -> Column:
        return F.struct(
            F.concat(F.col("id"), F.lit(suffix)).alias("alert_id"),
            F.lit(action).alias("action"),
            (F.col("triggered_at") + F.expr(f"interval {delay} seconds")).alias("at"),
            F.lit(None).cast("string").alias("note"),
            F.lit(n).cast("long").alias("seq"),
        )

    ack, resolve = al.ACKNOWLEDGE, al.RESOLVE
    kind = epoch_ms("triggered_at") % 5
    chosen = (
        F.when(kind == 1, F.array(command(ack, 60, 1), command(ack, 60, 1, "-missing")))
        .when(kind == 2, F.array(command(resolve, 60, 1)))
        .when(kind == 3, F.array(command(ack, 60, 1), command(resolve, 120, 2), command(ack, 180, 3)))
        .when(kind == 4, F.array(command(resolve, 60, 1), command(ack, 90, 2), command(resolve, 120, 3)))
    )
    return alerts.select(F.inline(chosen))


def _commanded(spark, sf) -> tuple[DataFrame, DataFrame]:
    table = materialize(_table(spark, sf), "alerts")
    return al.apply_commands(table, commands_for(table))


@query("ack_resolve")
def q_ack_resolve(spark, sf):
    after, _ = _commanded(spark, sf)
    return after.select(
        "id", "status", ms("acknowledged_at", "acknowledged_ms"), ms("resolved_at", "resolved_ms")
    )


@query("command_audit")
def q_command_audit(spark, sf):
    _, audit = _commanded(spark, sf)
    return audit.select("alert_id", "action", "seq", "accepted", "reject_reason")


@query("alerts_upgrade")
def q_alerts_upgrade(spark, sf):
    old = _table(spark, sf).drop("last_occurred_at", "repeat_count")
    return _alert_columns(al.upgrade(old))


# ---- stations

@query("station_last_seen")
def q_station_last_seen(spark, sf):
    accepted = ingest.accepted(ingest.outcomes(submissions(spark, sf), stations(spark, sf)))
    return st.touch_last_seen(stations(spark, sf), accepted).select("id", ms("last_seen_at", "last_seen_ms"))


@query("station_touch_now")
def q_station_touch_now(spark, sf):
    """Stations that report now, by the processing clock, here the end of the data."""
    asked = measurements(spark, sf).filter("seq % 7 = 0").select(F.col("station_id").alias("id"))
    touched = st.touch_now(stations(spark, sf), asked, clock_end(spark, sf))
    return touched.select("id", ms("last_seen_at", "last_seen_ms"))


def station_submissions(spark, sf) -> DataFrame:
    """Customers ask for stations; codes collide with stored ones and with each other."""
    key = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        F.lit(None).cast("string").alias("id"),
        F.concat(F.lit("ST-"), (key % 250).cast("string")).alias("station_code"),
        F.when(key % 31 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"),
        F.lit(None).cast("string").alias("river_name"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.when(key % 7 == 0, F.lit("bogus")).when(key % 3 == 0, F.lit("offline")).alias("status"),
        key.cast("long").alias("seq"),
    )


@query("stations_register")
def q_stations_register(spark, sf):
    return st.registration_outcomes(stations(spark, sf), station_submissions(spark, sf)).select(
        "seq", "station_code", "outcome"
    )


@query("stations_after_register")
def q_stations_after_register(spark, sf):
    return st.register(stations(spark, sf), station_submissions(spark, sf)).select(
        "station_code", "name", "status", F.col("created_at").isNotNull().alias("is_new")
    )


@query("stations_all")
def q_stations_all(spark, sf):
    return stations(spark, sf).select("id", "station_code", "name", "status")


@query("station_lookup")
def q_station_lookup(spark, sf):
    by_id = views.station_by_id(stations(spark, sf), STATION)
    by_code = views.station_by_code(stations(spark, sf), "ST-7")
    return by_id.unionByName(by_code).select("id", "station_code", "name")


# ---- read queries

def _reading(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "event_id", "station_id", ms("observed_at", "event_ms"), "water_level_m",
        "rainfall_mm_per_hour", *more,
    )


@query("recent_100")
def q_recent_100(spark, sf):
    return _reading(views.recent(measurements(spark, sf)))


@query("recent_50_of_station")
def q_recent_50_of_station(spark, sf):
    return _reading(views.recent_of_station(measurements(spark, sf), STATION))


@query("recent_50_per_station")
def q_recent_50_per_station(spark, sf):
    return _reading(views.recent_per_station(measurements(spark, sf)), "rank")


@query("station_history")
def q_station_history(spark, sf):
    return _reading(views.station_history(measurements(spark, sf), STATION))


@query("stored_event_ids")
def q_stored_event_ids(spark, sf):
    wanted = read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"))
    return views.existing_event_ids(measurements(spark, sf), wanted)


@query("latest_per_station")
def q_latest_per_station(spark, sf):
    return _reading(views.latest_per_station(measurements(spark, sf)))


@query("station_cards")
def q_station_cards(spark, sf):
    return views.station_cards(stations(spark, sf), measurements(spark, sf)).select(
        "id", "name", ms("observed_at", "event_ms"), "reading"
    )


@query("feed_30")
def q_feed_30(spark, sf):
    return views.feed(measurements(spark, sf), stations(spark, sf)).select(
        "station_name", ms("observed_at", "event_ms"), "water_level", "rainfall", "flow_rate", "event_id"
    )


@query("named_readings")
def q_named_readings(spark, sf):
    """Every reading with its station name and its printed values."""
    named = views.with_station_name(measurements(spark, sf), stations(spark, sf))
    return named.select("event_id", "station_name", views.fixed_or_dash("water_level_m", 2).alias("water_level"))


@query("active_alerts")
def q_active_alerts(spark, sf):
    after, _ = _commanded(spark, sf)
    return _alert_columns(views.active_alerts(after))


@query("station_alerts")
def q_station_alerts(spark, sf):
    after, _ = _commanded(spark, sf)
    return _alert_columns(views.station_alerts(after, STATION))


@query("alert_output")
def q_alert_output(spark, sf):
    after, _ = _commanded(spark, sf)
    return _alert_columns(
        views.alert_output(after), ms("acknowledged_at", "acknowledged_ms"), ms("resolved_at", "resolved_ms"))


@query("alert_actions")
def q_alert_actions(spark, sf):
    after, _ = _commanded(spark, sf)
    return views.with_actions(after).select(
        "id", "status", F.array_join("actions", ",").alias("actions"), "repeat_text"
    )


@query("panel_counts")
def q_panel_counts(spark, sf):
    after, _ = _commanded(spark, sf)
    return views.panel_counts(stations(spark, sf), after, measurements(spark, sf))
