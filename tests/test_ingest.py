import json
from datetime import datetime

from pyspark.sql import functions as F

from helpers import at, reading, readings
from tidewatch.operators import ingest
from tidewatch.operators.contracts import station_errors, with_submission_errors
from tidewatch.schemas import STATION
from tidewatch.sources.decode import decode_alert_events, decode_measurements, malformed, valid
from tidewatch.sources.wire import encode_alert_events, encode_measurements, to_wire_event

SID = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"


def payload(**changes):
    body = {
        "eventId": "evt-1", "stationId": SID, "observedAt": "2026-09-26T10:15:00Z",
        "waterLevelM": 2.0, "rainfallMmPerHour": 1.0, "flowRateM3S": 3.0, "schemaVersion": 1,
    }
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v != "absent"})


CASES = [
    (payload(), None),
    (payload(flowRateM3S="absent"), None),
    (payload(someFutureField={"x": 1}), None),
    (payload(waterLevelM=None, rainfallMmPerHour=None), None),
    (payload(flowRateM3S=-4.0), None),
    (payload(observedAt=1727345700.5), None),
    (payload(waterLevelM="2.5"), None),
    (payload(waterLevelM=" "), None),
    (payload(schemaVersion=1.7), None),
    (payload(stationId=SID.upper()), None),
    (payload(eventId=17), None),
    ("{not valid json", "JSON parse error"),
    ('{"waterLevelM": 2.0}', "missing eventId"),
    (payload(eventId="  "), "missing eventId"),
    (payload(eventId=None, stationId=None), "missing eventId"),
    (payload(stationId=None), "missing stationId"),
    (payload(stationId=""), "missing stationId"),
    (payload(observedAt="absent"), "missing observedAt"),
    (payload(schemaVersion=None), "missing schemaVersion"),
    (payload(waterLevelM=-1.0), "negative waterLevelM"),
    (payload(waterLevelM=-1.0, rainfallMmPerHour=-1.0), "negative waterLevelM"),
    (payload(rainfallMmPerHour=-0.1), "negative rainfallMmPerHour"),
    (None, "empty record value"),
    ("", "empty record value"),
    (" \t\n", "empty record value"),
    ("null", "JSON parse error"),
    ("[1]", "JSON parse error"),
    ('"text"', "JSON parse error"),
    ('{"waterLevelM":{"a":1}}', "JSON parse error"),
    (payload(waterLevelM=True), "JSON parse error"),
    (payload(waterLevelM="deep"), "JSON parse error"),
    (payload(observedAt="yesterday"), "JSON parse error"),
    (payload(stationId="not-a-uuid"), "JSON parse error"),
    (payload(eventId={"a": 1}), "JSON parse error"),
]


def raw(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "seq long, value string")


def test_decoder_verdicts(spark):
    got = {r.seq: r.error for r in decode_measurements(raw(spark)).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}


def test_decoded_values(spark):
    rows = {r.seq: r for r in valid(decode_measurements(raw(spark))).collect()}
    assert rows[0].station_id == SID and rows[0].observed_at == datetime(2026, 9, 26, 10, 15)
    assert rows[5].observed_at == datetime(2024, 9, 26, 10, 15, 0, 500000)
    assert rows[6].water_level_m == 2.5 and rows[7].water_level_m is None
    assert rows[8].schema_version == 1 and rows[9].station_id == SID and rows[10].event_id == "17"


def test_malformed_side_record(spark):
    side = {r.seq: r.record for r in malformed(decode_measurements(raw(spark))).collect()}
    assert len(side) == sum(1 for c in CASES if c[1])
    assert side[11] == "malformed measurement: JSON parse error | raw={not valid json"
    assert side[22] == "malformed measurement: empty record value | raw=null"


def test_parsing_is_not_repeated_by_a_filter(spark):
    plan = valid(decode_measurements(raw(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1


def test_wire_projection_and_round_trip(spark):
    stored = readings(spark, [reading(1, 15, 2.5, 1.0, event_id="evt-002")]).withColumn("id", F.lit("row-7"))
    wire = to_wire_event(stored)
    assert wire.columns == [
        "event_id", "station_id", "observed_at", "water_level_m", "rainfall_mm_per_hour",
        "flow_rate_m3s", "schema_version",
    ]
    record = encode_measurements(wire).first()
    assert record.key == "s1"
    assert json.loads(record.value) == {
        "eventId": "evt-002", "stationId": "s1", "observedAt": "2026-09-26T10:15:00Z",
        "waterLevelM": 2.5, "rainfallMmPerHour": 1.0, "flowRateM3S": None, "schemaVersion": 1,
    }
    back = decode_measurements(encode_measurements(wire), check_uuid=False).select(*wire.columns)
    assert back.collect() == wire.collect()


def test_alert_event_record(spark):
    from tidewatch.schemas import ALERT_EVENT

    event = spark.createDataFrame(
        [("a", None, "LEVEL_HIGH", "HIGH", "ACTIVE", "t", None, '{"b":1.5,"a":null}', at(), None, None, at(0.0005), 2, 1)],
        ALERT_EVENT,
    )
    record = encode_alert_events(event).first()
    body = json.loads(record.value)
    assert record.key is None and body["stationId"] is None and body["reason"] is None
    assert body["evidence"] == {"a": None, "b": 1.5}
    assert body["triggeredAt"] == "2026-09-26T10:00:00Z" and body["lastOccurredAt"] == "2026-09-26T10:00:00.030Z"
    back = decode_alert_events(encode_alert_events(event)).first()
    # ids are checked to be UUIDs unless told otherwise
    assert back.error == "JSON parse error"


def test_submission_contract_names_every_field(spark):
    rows = readings(spark, [
        reading(1, 0, 1.0, 1.0), (" ", None, None, None, None, None, None, None, 2),
        ("e", "s", at(), -1.0, -2.0, None, 0, None, 3), ("e", "s", at(), float("nan"), 0.0, None, 1, None, 4),
    ])
    got = {r.seq: r.errors for r in with_submission_errors(rows).collect()}
    assert got[1] == {}
    assert got[2] == {
        "eventId": "must not be blank", "stationId": "must not be null", "observedAt": "must not be null",
        "waterLevelM": "must not be null", "rainfallMmPerHour": "must not be null",
        "schemaVersion": "must not be null",
    }
    assert got[3] == {
        "waterLevelM": "must be greater than or equal to 0",
        "rainfallMmPerHour": "must be greater than or equal to 0", "schemaVersion": "must be greater than 0",
    }
    assert set(got[4]) == {"waterLevelM"}


def test_station_contract(spark):
    rows = spark.createDataFrame([("c", "n"), (" ", None)], "station_code string, name string")
    got = [r.e for r in rows.select(station_errors().alias("e")).collect()]
    assert got == [{}, {"stationCode": "must not be blank", "name": "must not be blank"}]


def stations(spark, *ids):
    return spark.createDataFrame([(i, i, i, None, None, None, "ONLINE", None, None) for i in ids], STATION)


def test_outcomes_check_station_before_duplicates(spark):
    rows = readings(spark, [
        reading(1, 0, 1.0, 1.0, station="nowhere", event_id="x"),
        reading(3, 0, 2.0, 1.0, event_id="x"), reading(2, 0, 3.0, 1.0, event_id="x"),
        reading(4, 0, 4.0, 1.0, event_id="old"), reading(5, 0, None, 1.0, event_id="y"),
        reading(6, 0, 4.0, 1.0, event_id="y"),
    ])
    stored = spark.createDataFrame([("old",)], "event_id string")
    labelled = ingest.outcomes(rows, stations(spark, "s1"), stored)
    got = {r.seq: (r.outcome, r.message) for r in labelled.collect()}
    assert got == {
        1: ("ERROR", "Station not found"),
        2: ("ACCEPTED", "Measurement accepted for processing"),
        3: ("DUPLICATE", "Measurement with this eventId already exists"),
        4: ("DUPLICATE", "Measurement with this eventId already exists"),
        5: ("ERROR", "Validation failed"),
        6: ("ACCEPTED", "Measurement accepted for processing"),
    }
    assert {r.water_level_m for r in ingest.accepted(labelled).collect()} == {3.0, 4.0}


def test_first_arrival_of_a_hot_id(spark):
    rows = readings(spark, [reading(i, i, float(i), 1.0, event_id="hot" if i % 3 else f"e{i}") for i in range(1, 300)])
    firsts = {r.event_id: r.seq for r in ingest.first_arrivals(rows).collect()}
    assert firsts["hot"] == 1 and len(firsts) == 1 + 99
    kept = ingest.first_arrivals(rows, spark.createDataFrame([("hot",)], "event_id string"))
    assert kept.count() == 99
    plan = ingest.first_arrivals(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_known_and_unknown_stations_split(spark):
    rows = readings(spark, [reading(1, 0), reading(2, 0, station="zz")])
    assert [r.seq for r in ingest.known_station(rows, stations(spark, "s1")).collect()] == [1]
    assert [r.seq for r in ingest.unknown_station(rows, stations(spark, "s1")).collect()] == [2]


def test_receive_stamp(spark):
    stamped = ingest.stamp_received(readings(spark, [reading(1, 0), reading(2, 1)]))
    assert stamped.select("received_at").distinct().count() == 1
