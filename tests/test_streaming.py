"""End-to-end streaming runs over folders of JSON lines."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from helpers import at, readings, reading
from tidewatch.config import RuleConfig
from tidewatch.operators import rules
from tidewatch.operators.rising import rising_candidates, rising_windows
from tidewatch.operators.spike import spike_baseline, spike_candidates, spikes
from tidewatch.operators.suppression import suppress
from tidewatch.operators import stored as stored_reads
from tidewatch.schemas import ALERT_EVENT, STATION
from tidewatch.sources.topics import from_kafka, in_arrival_order, read_folder, write_folder
from tidewatch.streaming import jobs
from tidewatch.streaming.alert_table import AlertTable
from tidewatch.streaming.kept import LATEST, last_seen_view, latest_view

NOW = {"availableNow": True}
SOON = {"processingTime": "0 seconds"}


def stations_of(spark, *ids):
    return spark.createDataFrame([(i, f"C{i}", f"Station {i}", None, None, None, "ONLINE", None, None) for i in ids], STATION)


def message(seq, minutes, level, rain, station="s1", event_id=None, **more):
    body = {
        "eventId": event_id or f"e{seq}", "stationId": station,
        "observedAt": at(minutes).strftime("%Y-%m-%dT%H:%M:%SZ"), "waterLevelM": level,
        "rainfallMmPerHour": rain, "schemaVersion": 1, **more,
    }
    return seq, json.dumps(body)


def drop_file(folder, number, messages):
    """One file per micro-batch; the file source orders files by modification time."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:04d}.json"
    with open(f"{folder}/.{number}", "w") as out:
        for seq, value in messages:
            out.write(json.dumps({"seq": seq, "key": "k", "value": value, "received_at": at().isoformat()}) + "\n")
    os.rename(f"{folder}/.{number}", path)
    stamp = time.time() - 10_000 + number * 10
    os.utime(path, (stamp, stamp))


def finish(query, seconds=240):
    assert query.awaitTermination(seconds), "query did not finish in time"
    assert query.exception() is None


def drain(query, files, idle=3, seconds=240):
    """Run until all files are read and some batches without data have followed, then stop.

    A processing-time operator asks for a batch at every trigger, so such a query never ends itself.
    """
    deadline, done_at = time.time() + seconds, None
    try:
        while time.time() < deadline:
            assert query.exception() is None
            progress = query.lastProgress
            if progress is not None:
                end = str(progress["sources"][0]["endOffset"])
                read = int(re.search(r"\d+", end).group()) + 1
                if read >= files and done_at is None:
                    done_at = progress["batchId"]
                if done_at is not None and progress["batchId"] >= done_at + idle:
                    return
            time.sleep(0.5)
        raise AssertionError("stream did not drain in time")
    finally:
        query.stop()


def wave(n, start=0):
    """Readings two minutes apart with rises, spikes, rain and a null level."""
    levels = [2.0, 2.1, 2.05, 2.6, 5.0, 2.2, None, 4.1, 2.0, 3.2]
    return [
        (i, i * 2, levels[i % 10], 16.0 if i % 4 == 0 else 21.0 if i % 7 == 0 else 1.0)
        for i in range(start, start + n)
    ]


def test_alert_stream_equals_batch_replay(spark, tmp_path, config):
    topic, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = wave(60)
    # the last reading only moves the watermark past every window of interest
    for number, first in enumerate(range(0, 60, 12)):
        drop_file(topic, number, [message(i, m, lv, r) for i, m, lv, r in rows[first:first + 12]])
    drop_file(topic, 99, [message(1000, 600, 0.1, 0.1)])

    stream = jobs.alert_stream(jobs.measurement_stream(read_folder(spark, topic, 1), check_uuid=False), config)
    drain(jobs.start("alerts_equal", stream, lambda df, b: write_folder(df, out, b), str(tmp_path / "cp"), SOON), 6)
    columns = ["id", "rule_code", "triggered_at", "last_occurred_at", "repeat_count", "seq", "reason", "evidence"]
    got = spark.read.schema(stream.schema).json(f"{out}/*").select(*columns)

    table = readings(spark, [reading(i, m, lv, r) for i, m, lv, r in rows] + [reading(1000, 600, 0.1, 0.1)])
    expected = suppress(
        rules.threshold_candidates(table, config)
        .unionByName(spike_candidates(spikes(spike_baseline(table, config), config), config))
        .unionByName(rising_candidates(rising_windows(table, config), config)),
        config, chunk_rows=8,
    ).select(*columns)
    want = {tuple(r) for r in expected.filter("rule_code != 'STATION_STALE'").collect()}
    have = {tuple(r) for r in got.filter("rule_code != 'STATION_STALE'").collect()}
    assert {r[1] for r in want} == {
        "LEVEL_HIGH", "RAIN_INTENSE", "LEVEL_AND_RAIN", "SENSOR_SPIKE", "LEVEL_RISING_FAST"
    }
    assert have == want


def test_suppression_state_survives_a_restart(spark, tmp_path, config):
    topic, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def run(files):
        stream = jobs.alert_stream(
            jobs.measurement_stream(read_folder(spark, topic, 1), check_uuid=False), config
        )
        drain(jobs.start("alerts_restart", stream, lambda df, b: write_folder(df, out, b), cp, SOON), files, 1)

    drop_file(topic, 0, [message(1, 0, 5.0, 0.0)])
    run(1)
    drop_file(topic, 1, [message(2, 10, 5.0, 0.0)])
    run(2)
    rows = (
        spark.read.json(f"{out}/*").filter("rule_code = 'LEVEL_HIGH'").orderBy("seq").collect()
    )
    assert [r.repeat_count for r in rows] == [1, 2]
    assert rows[0].id == rows[1].id


def test_silent_station_fires_once(spark, tmp_path):
    quick = RuleConfig(stale_min=1)
    topic, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop_file(topic, 0, [message(1, 0, 1.0, 0.0)])
    from tidewatch.streaming.processors import STATION_FACT, StationState

    # a timeout of two seconds: the rule itself counts in minutes
    state = StationState(quick)
    state.stale_ms = 2_000
    facts = (
        jobs.measurement_stream(read_folder(spark, topic, 1), check_uuid=False)
        .select("station_id", "seq", "water_level_m", F.unix_millis("observed_at").alias("event_ms"))
        .groupBy("station_id")
        .transformWithState(state, STATION_FACT, "append", "processingTime")
    )
    query = jobs.start(
        "stale_once", facts, lambda df, b: write_folder(df, out, b), str(tmp_path / "cp"),
        {"processingTime": "1 second"},
    )
    try:
        deadline = time.time() + 60
        rows = []
        while time.time() < deadline and not rows:
            time.sleep(2)
            if os.path.exists(out):
                rows = spark.read.schema(facts.schema).json(f"{out}/*").collect()
        time.sleep(5)
        rows = spark.read.schema(facts.schema).json(f"{out}/*").collect()
    finally:
        query.stop()
    assert [(r.station_id, r.rule_code) for r in rows] == [("s1", "STATION_STALE")]
    assert rows[0].last_observed_ms == int(at().timestamp() * 1000)


def test_ingest_stream_routes_every_record(spark, tmp_path, config):
    topic, base, measurements = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "m")
    drop_file(topic, 0, [
        message(1, 60, 1.0, 1.0), message(2, 60, 1.5, 1.0, event_id="e1"), (3, "{broken"), (4, None),
        message(5, 61, 1.0, 1.0, station="nowhere"), message(6, 61, -1.0, 1.0), message(7, 61, None, 1.0),
    ])
    # batch 1: the same id again with another payload, and a reading behind every open window
    drop_file(topic, 1, [message(8, 62, 9.0, 1.0, event_id="e1"), message(9, 30, 1.0, 1.0), message(10, 50, 1.0, 1.0)])
    stations = stations_of(spark, "s1")
    labelled = jobs.labelled_submissions(read_folder(spark, topic, 1), stations, check_uuid=False)
    sink = jobs.ingest_sink(base, config, lambda df, b: write_folder(df, measurements, b))
    finish(jobs.start("ingest", labelled, sink, str(tmp_path / "cp"), NOW))

    audit = {r.seq: (r.outcome, r.message) for r in spark.read.parquet(f"{base}/audit").collect()}
    assert audit == {
        1: ("ACCEPTED", "Measurement accepted for processing"),
        2: ("DUPLICATE", "Measurement with this eventId already exists"),
        3: ("MALFORMED", "JSON parse error"),
        4: ("MALFORMED", "empty record value"),
        5: ("ERROR", "Station not found"),
        6: ("MALFORMED", "negative waterLevelM"),
        7: ("ERROR", "Validation failed"),
        8: ("DUPLICATE", "Measurement with this eventId already exists"),
        9: ("ACCEPTED", "Measurement accepted for processing"),
        10: ("ACCEPTED", "Measurement accepted for processing"),
    }
    stored = spark.read.parquet(f"{base}/measurements")
    assert {(r.event_id, r.water_level_m) for r in stored.collect()} == {("e1", 1.0), ("e9", 1.0), ("e10", 1.0)}
    assert [r.event_id for r in spark.read.parquet(f"{base}/late").collect()] == ["e9"]
    quarantined = spark.read.parquet(f"{base}/quarantine")
    assert "malformed measurement: JSON parse error | raw={broken" in {r.record for r in quarantined.collect()}
    published = spark.read.json(f"{measurements}/*")
    assert {r.key for r in published.collect()} == {"s1"} and published.count() == 3
    assert json.loads(published.filter("seq = 1").first().value)["eventId"] == "e1"

    # a run under a new checkpoint keeps what the first one stored
    more = str(tmp_path / "more")
    drop_file(more, 0, [message(20, 70, 1.0, 1.0)])
    labelled = jobs.labelled_submissions(read_folder(spark, more, 1), stations, check_uuid=False)
    view = last_seen_view(spark, f"{base}/last_seen")
    sink = jobs.ingest_sink(base, config, lambda df, b: write_folder(df, measurements, b), [view])
    finish(jobs.start("ingest_again", labelled, sink, str(tmp_path / "cp2"), NOW))
    stored = spark.read.parquet(f"{base}/measurements")
    assert {r.event_id for r in stored.collect()} == {"e1", "e9", "e10", "e20"}
    assert [(r.station_id, r.seq) for r in view.read().collect()] == [("s1", 20)]
    assert {r.seq for r in spark.read.json(f"{measurements}/*").collect()} == {1, 9, 10, 20}
    assert os.listdir(f"{base}/measurements")[0].startswith("observed_date=") or "_SUCCESS" in os.listdir(f"{base}/measurements")


def test_records_keep_their_arrival_order(spark):
    rows = [("k%d" % (i % 3) if i % 7 else None, f"v{i}", i * 3) for i in range(200)]
    frame = in_arrival_order(spark.createDataFrame(rows, "key string, value string, seq long").repartition(9))
    parts = frame.select("key", F.spark_partition_id().alias("part"), F.expr("cast(headers[0].value as string)").alias("seq")).collect()
    by_key = {}
    for r in parts:
        by_key.setdefault(r.key, []).append(r)
    assert all([int(r.seq) for r in by_key[k]] == sorted(int(r.seq) for r in by_key[k]) for k in ("k0", "k1", "k2"))
    assert all(len({r.part for r in by_key[k]}) == 1 for k in ("k0", "k1", "k2"))


def test_arrival_numbers_of_many_partitions(spark):
    kafka = spark.range(3000).selectExpr(
        "cast(null as binary) AS key", "cast('v' as binary) AS value", "cast(id % 1500 as int) AS partition",
        "id div 1500 AS offset", "timestamp'2026-01-01' AS timestamp",
        "if(id = 7, array(named_struct('key', 'seq', 'value', cast('12345678' as binary))), null) AS headers")
    numbers = [r.seq for r in from_kafka(kafka, 1500).collect()]
    assert len(set(numbers)) == 3000 and 12345678 in numbers
    with pytest.raises(Exception, match="more partitions than stated"):
        from_kafka(kafka, 1024).collect()


def test_event_stream_reads_both_layouts(spark, tmp_path):
    from tidewatch.sources.events import event_stream, measurements

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    one, many = tmp_path / "one", tmp_path / "many"
    events.repartition(4).write.parquet(str(many / "events.parquet"))
    events.coalesce(1).write.parquet(str(tmp_path / "written"))
    os.makedirs(one)
    for name in os.listdir(tmp_path / "written"):
        if name.endswith(".parquet"):
            os.link(tmp_path / "written" / name, one / "events.parquet")
            os.link(tmp_path / "written" / name, one / "events_old.parquet")
    for k, folder in enumerate((one, many)):
        counts = []
        query = (event_stream(spark, str(folder)).writeStream.option("checkpointLocation", str(tmp_path / f"cp{k}"))
                 .trigger(availableNow=True).foreachBatch(lambda df, _: counts.append(df.count())).start())
        finish(query)
        assert sum(counts) == events.count() == measurements(spark, str(folder)).count()


def test_alert_records_reach_the_table(spark, tmp_path, config):
    topic, base = str(tmp_path / "in"), str(tmp_path / "store")

    def event(seq, id_, minutes, count, station="s1"):
        stamp = at(minutes).strftime("%Y-%m-%dT%H:%M:%SZ")
        return seq, json.dumps({
            "id": id_, "stationId": station, "ruleCode": "LEVEL_HIGH", "severity": "high", "status": "RESOLVED",
            "title": "t", "reason": "r", "evidence": {"a": 1}, "triggeredAt": at().strftime("%Y-%m-%dT%H:%M:%SZ"),
            "lastOccurredAt": stamp, "repeatCount": count,
        })

    def command(seq, id_, action, minutes):
        return seq, json.dumps({"alert_id": id_, "action": action, "at": at(minutes).isoformat()})

    commands = str(tmp_path / "commands")
    drop_file(topic, 0, [event(1, "a", 0, 1), event(2, "b", 0, 1), event(3, "c", 0, 1, "nowhere"), (4, "{bad")])
    os.makedirs(commands)
    table = AlertTable(spark, f"{base}/alerts")
    sink = jobs.persistence_sink(table, lambda: stations_of(spark, "s1"), base, check_uuid=False)

    def run():
        stream = jobs.persistence_stream(read_folder(spark, topic, 1), read_folder(spark, commands, 1))
        finish(jobs.start("persist", stream, sink, str(tmp_path / "cp"), NOW))

    run()
    assert {(r.id, r.status, r.severity) for r in table.read().collect()} == {("a", "ACTIVE", "HIGH"), ("b", "ACTIVE", "HIGH")}
    drop_file(commands, 1, [command(1, "a", "ACKNOWLEDGE", 5), command(2, "zz", "RESOLVE", 5), (3, "[nothing")])
    run()
    drop_file(topic, 2, [event(5, "a", 20, 2)])
    run()
    rows = {r.id: r for r in table.read().collect()}
    assert (rows["a"].status, rows["a"].repeat_count) == ("ACKNOWLEDGED", 2)
    assert (rows["b"].status, rows["b"].repeat_count) == ("ACTIVE", 1)
    assert json.loads(rows["a"].evidence) == {"a": 1}
    rejects = spark.read.parquet(f"{base}/alert_rejects").collect()
    assert [(r.id, r.reject_reason) for r in rejects] == [("c", "unknown station")]
    assert spark.read.parquet(f"{base}/alert_quarantine").count() == 1
    assert spark.read.parquet(f"{base}/command_quarantine").count() == 1
    audit = {(r.alert_id, r.accepted, r.reject_reason) for r in spark.read.parquet(f"{base}/command_audit").collect()}
    assert audit == {("a", True, None), ("zz", False, "Alert not found")}
    # a batch that runs again changes nothing
    before = table.manifest()
    (name,) = before["committed"]
    table.apply(0, spark.createDataFrame([], ALERT_EVENT), stations_of(spark, "s1"), run=name)
    assert table.manifest() == before
    # a run under a new checkpoint starts over: it repeats old records without harm and adds new ones
    drop_file(topic, 3, [event(6, "d", 30, 1)])
    stream = jobs.persistence_stream(read_folder(spark, topic, 1), read_folder(spark, commands, 1))
    finish(jobs.start("persist_again", stream, sink, str(tmp_path / "cp2"), NOW))
    assert len(table.manifest()["committed"]) == 2
    assert {(r.id, r.status, r.repeat_count) for r in table.read().collect()} == {
        ("a", "ACKNOWLEDGED", 2), ("b", "ACTIVE", 1), ("d", "ACTIVE", 1)}


def test_a_repeated_batch_keeps_its_rejects(spark, tmp_path):
    """An event without trigger time ahead of a timed one of the same alert is turned away, also the second time."""
    def event(seq, minutes):
        return ("a", "s1", "LEVEL_HIGH", "HIGH", "ACTIVE", "t", "r", "{}", None if minutes is None else at(minutes), None,
                None, at(minutes or 0), 1, seq)

    events = spark.createDataFrame([event(1, None), event(2, 5)], ALERT_EVENT)
    table, seen = AlertTable(spark, str(tmp_path / "alerts")), []
    for _ in range(2):
        table.apply(0, events, stations_of(spark, "s1"), run="r",
                    rejects=lambda rows: seen.append([(r.seq, r.reject_reason) for r in rows.collect()]))
    assert len(seen) == 1 and [seq for seq, _ in seen[0]] == [1]
    assert [r.id for r in table.read().collect()] == ["a"]


def test_a_station_registered_between_two_batches(spark, tmp_path):
    topic, changes, out, cp = (str(tmp_path / n) for n in ("in", "stations", "out", "cp"))
    os.makedirs(changes)

    def run():
        labelled = jobs.labelled_submissions(
            read_folder(spark, topic, 1), stations_of(spark, "s1"), check_uuid=False,
            registered=jobs.station_changes(read_folder(spark, changes, 1)), shares=2)
        finish(jobs.start("live", labelled, lambda df, b: write_folder(df, out, b), cp, NOW))
        return {r.seq: r.outcome for r in spark.read.json(f"{out}/*").collect()}

    drop_file(topic, 0, [message(1, 0, 1.0, 1.0), message(2, 0, 1.0, 1.0, station="s2"), message(3, 0, 1.0, 1.0, station="s3")])
    assert run() == {1: "ACCEPTED", 2: "ERROR", 3: "ERROR"}
    drop_file(changes, 1, [(1, '{"id": "s2"}'), (2, "{broken"), (3, "{}")])
    drop_file(topic, 1, [message(s, 1, 1.0, 1.0, station="s2") for s in (4, 5)] + [message(6, 1, 1.0, 1.0, station="s3"), (7, None)])
    assert {k: v for k, v in run().items() if k > 3} == {4: "ACCEPTED", 5: "ACCEPTED", 6: "ERROR", 7: "MALFORMED"}


def test_ids_stored_under_another_checkpoint(spark, tmp_path, config):
    base = str(tmp_path / "store")
    for k, seqs in enumerate([(1, 2), (3, 4)]):
        topic = str(tmp_path / f"in{k}")
        drop_file(topic, 0, [message(s, s, 1.0, 1.0, event_id=f"e{s % 3}") for s in seqs])
        stored = stored_reads.of_dates(spark, f"{base}/measurements", stored_reads.dates(spark, f"{base}/measurements"))
        labelled = jobs.labelled_submissions(read_folder(spark, topic, 1), stations_of(spark, "s1"), check_uuid=False, stored=stored)
        finish(jobs.start(f"seeded{k}", labelled, jobs.ingest_sink(base, config, lambda df, b: None), str(tmp_path / f"cp{k}"), NOW))
    assert {r.seq: r.outcome for r in spark.read.parquet(f"{base}/audit").collect()} == {
        1: "ACCEPTED", 2: "ACCEPTED", 3: "ACCEPTED", 4: "DUPLICATE"}


def test_a_batch_of_nothing_accepted(spark, tmp_path, config):
    topic, base = str(tmp_path / "in"), str(tmp_path / "store")
    drop_file(topic, 0, [message(1, 60, 1.0, 1.0)])
    drop_file(topic, 1, [(2, "{broken"), message(3, 90, 1.0, 1.0, station="nowhere")])
    drop_file(topic, 2, [message(4, 30, 1.0, 1.0)])
    labelled = jobs.labelled_submissions(read_folder(spark, topic, 1), stations_of(spark, "s1"), check_uuid=False)
    finish(jobs.start("nothing", labelled, jobs.ingest_sink(base, config, lambda df, b: None), str(tmp_path / "cp"), NOW))
    # the highest event time lives on over the empty batch
    assert [r.event_id for r in spark.read.parquet(f"{base}/late").collect()] == ["e4"]


def test_kept_views(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), at(rng.randrange(50)), float(i), None, i) for i in range(300)]
    rng.shuffle(rows)
    batches = [rows[i:i + 30] for i in range(0, 300, 30)]
    latest = latest_view(spark, str(tmp_path / "latest"), merge_after=3)
    seen = last_seen_view(spark, str(tmp_path / "seen"), merge_after=3)
    assert latest.read().isEmpty()
    # some batches run again, also after their part was merged
    for k in [*range(10), 0, 4, 9]:
        frame = spark.createDataFrame(batches[k], LATEST)
        latest.add(frame, f"run-{k}")
        seen.add(frame, f"run-{k}")
    want = {s: max((r for r in rows if r[0] == s), key=lambda r: (r[1], -r[4]))[4] for s in "abc"}
    assert {r.station_id: r.seq for r in latest.read().collect()} == want
    assert {r.station_id: r.seq for r in seen.read().collect()} == {s: max(r[4] for r in rows if r[0] == s) for s in "abc"}
    assert len(os.listdir(tmp_path / "latest")) < 10


def test_stored_reads_touch_the_newest_dates_only(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [reading(i, i * 180, 1.0, station="s1" if i % 40 else "rare") for i in range(400)]
    for k in range(2):
        stored_reads.store(readings(spark, rows[k * 200:k * 200 + 200]), path, f"run-{k}")
    stored_reads.store(readings(spark, rows[200:]), path, "run-1")  # again
    recent = stored_reads.recent(spark, path, 10)
    assert [r.seq for r in recent.collect()] == list(range(399, 389, -1))
    newest = set(stored_reads.dates(spark, path)[:2])
    assert {f.split("observed_date=")[1][:10] for f in recent.inputFiles()} <= newest
    assert [r.seq for r in stored_reads.recent_of_station(spark, path, "rare", 3).collect()] == [360, 320, 280]
    assert stored_reads.recent(spark, path, 1000).count() == 400
    assert stored_reads.recent(spark, str(tmp_path / "none"), 10).isEmpty()
    days = stored_reads.dates(spark, path)[2:4]
    assert {r.observed_at.strftime("%Y-%m-%d") for r in stored_reads.between(spark, path, days[1], days[0]).collect()} == set(days)


def test_event_ids_are_remembered_natively_and_grouped(spark, tmp_path):
    topic = str(tmp_path / "in")
    drop_file(topic, 0, [message(s, 1, 1.0, 1.0, event_id=f"e{s // 2}") for s in (5, 4, 3, 2)] + [message(9, 1, 1.0, 1.0, event_id="old")])
    drop_file(topic, 1, [message(10 + s, 2, 1.0, 1.0, event_id=f"e{s}") for s in (1, 2, 3, 3)])
    stored = spark.createDataFrame([("old",), ("old",), (None,)], "event_id string")
    labelled = jobs.labelled_submissions(read_folder(spark, topic, 1), stations_of(spark, "s1"), check_uuid=False, stored=stored)
    # one call of Python per id and several per state access took a millisecond a reading
    plan = labelled._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan
    out = str(tmp_path / "out")
    finish(jobs.start("native", labelled, lambda df, b: write_folder(df, out, b), str(tmp_path / "cp"), NOW))
    rows = spark.read.json(f"{out}/*").collect()
    assert sorted((r.seq, r.outcome) for r in rows) == [
        (2, "ACCEPTED"), (3, "DUPLICATE"), (4, "ACCEPTED"), (5, "DUPLICATE"), (9, "DUPLICATE"), (11, "DUPLICATE"),
        (12, "DUPLICATE"), (13, "ACCEPTED"), (13, "DUPLICATE")]


def test_first_arrivals_over_several_batches():
    import pyarrow as pa

    from tidewatch.streaming.processors import ARRIVAL, NEW_ID, STORED_ID, first_arrivals

    rows = [("a", 5, ARRIVAL), ("a", 3, ARRIVAL), ("b", 4, ARRIVAL), ("c", 1, ARRIVAL), ("d", None, STORED_ID), ("d", 2, ARRIVAL),
            ("d", None, NEW_ID), ("a", None, NEW_ID), ("a", 2, ARRIVAL), ("b", 9, ARRIVAL), ("c", None, NEW_ID)]
    for size in (1, 2, 5, 11):
        batches = [pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows[k:k + size]), (pa.string(), pa.int64(), pa.int32()))],
            names=["event_id", "seq", "_kind"]) for k in range(0, len(rows), size)]
        found = [tuple(r.values()) for out in first_arrivals(iter(batches)) for r in out.to_pylist()]
        assert sorted(found) == [("a", 2, False), ("a", 3, True), ("a", 5, True), ("b", 4, True), ("b", 9, True),
                                 ("c", 1, False), ("d", 2, True)]


def test_rows_of_a_run_leave_block_by_block(config):
    import pandas as pd

    from tidewatch.streaming.processors import RUN_COLUMNS, RunState

    class Kept:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    rnd = random.Random(4)
    rows = [(seq, rnd.randrange(40) * config.suppression_ms // 4) for seq in range(600)]
    want, run = {}, None
    for seq, ms in rows:
        run = (run[0], run[1], ms, run[3] + 1) if run and ms - run[2] < config.suppression_ms else (seq, ms, ms, 1)
        want[seq] = (run[0], run[1], run[3])
    state, found = RunState(config), {}
    state.run = Kept()
    for batch in (rows[:1], rows[1:250], rows[250:]):
        shuffled = rnd.sample(batch, len(batch))
        blocks = [pd.DataFrame([("s", "r", "HIGH", "t", f"r{seq}", None, ms, seq) for seq, ms in shuffled[k:k + 40]], columns=RUN_COLUMNS[:8])
                  for k in range(0, len(batch), 40)]
        left = list(state.handleInputRows(("s", "r"), iter(blocks), None))
        assert [len(b) for b in left] == [len(b) for b in blocks]
        for block in left:
            assert list(block.columns) == RUN_COLUMNS and all(r.reason == f"r{r.seq}" for r in block.itertuples())
            found |= {r.seq: (r.first_seq, r.triggered_ms, r.repeat_count) for r in block.itertuples()}
    assert found == want and state.run.value == run
