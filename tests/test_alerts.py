import random


import pytest
from pyspark.sql import functions as F

from helpers import at
from tidewatch.functions.expr import parse_severity, parse_station_status, to_fixed, with_json_entry
from tidewatch.operators import alerts as al
from tidewatch.operators import stations as st
from tidewatch.operators import views
from tidewatch.schemas import ALERT, ALERT_EVENT, COMMAND, STATION
from tidewatch.streaming.alert_table import AlertTable
from helpers import reading, readings


def event(seq, id_="a", minutes=0, count=1, station="s1", severity="HIGH", last="same", status="ACTIVE", triggered=0):
    last_at = at(minutes) if last == "same" else last
    return (
        id_, station, "LEVEL_HIGH", severity, status, "title", f"reason {seq}", f'{{"n":{seq}}}',
        None if triggered is None else at(triggered), None, None, last_at, count, seq,
    )


def events(spark, *rows):
    return spark.createDataFrame(list(rows), ALERT_EVENT)


def alert(id_="a", status="ACTIVE", ack=None, resolved=None, count=1, minutes=0, station="s1"):
    return (
        id_, station, "LEVEL_HIGH", "HIGH", status, "title", "reason", "{}", at(minutes),
        None if ack is None else at(ack), None if resolved is None else at(resolved), at(minutes), count,
    )


def alerts(spark, *rows):
    return spark.createDataFrame(list(rows), ALERT)


def stations(spark, *ids):
    return spark.createDataFrame([(i, f"C-{i}", f"Station {i}", None, None, None, "ONLINE", None, None) for i in ids], STATION)


def clock(minutes):
    return at(minutes).replace(tzinfo=None)


# ---- upsert

def test_insert_is_active_whatever_the_event_says(spark):
    row = al.upsert(None, events(spark, event(1, status="RESOLVED"))).first()
    assert (row.id, row.status, row.repeat_count, row.acknowledged_at) == ("a", "ACTIVE", 1, None)


def test_redelivery_changes_nothing(spark):
    batch = events(spark, event(1), event(2, minutes=5, count=2))
    once = al.upsert(None, batch)
    assert al.upsert(once, batch).collect() == once.collect()


def test_repeat_keeps_acknowledgement(spark):
    stored = alerts(spark, alert(status="ACKNOWLEDGED", ack=5))
    row = al.upsert(stored, events(spark, event(9, minutes=20, count=2))).first()
    assert (row.status, row.acknowledged_at) == ("ACKNOWLEDGED", clock(5))
    assert (row.repeat_count, row.last_occurred_at, row.reason, row.evidence) == (2, clock(20), "reason 9", '{"n":9}')


def test_repeat_never_reopens_a_resolved_alert(spark):
    stored = alerts(spark, alert(status="RESOLVED", resolved=7))
    row = al.upsert(stored, events(spark, event(9, minutes=20, count=3))).first()
    assert (row.status, row.resolved_at, row.repeat_count) == ("RESOLVED", clock(7), 3)


def test_update_keeps_trigger_and_station(spark):
    stored = alerts(spark, alert())
    row = al.upsert(stored, events(spark, event(9, triggered=3, station="s2"))).first()
    assert (row.triggered_at, row.station_id) == (clock(0), "s1")


def test_last_arrival_wins_without_monotonicity(spark):
    row = al.upsert(None, events(spark, event(1, minutes=9, count=7), event(2, minutes=1, count=2))).first()
    assert (row.repeat_count, row.last_occurred_at) == (2, clock(1))


def test_defaults_and_severity(spark):
    row = al.upsert(None, events(spark, event(1, count=None, last=None, severity="bogus"))).first()
    assert (row.repeat_count, row.last_occurred_at, row.severity) == (1, clock(0), "WARNING")


def test_update_can_clear_optional_fields(spark):
    cleared = list(event(3))
    cleared[6] = cleared[7] = None
    row = al.upsert(alerts(spark, alert()), events(spark, tuple(cleared))).first()
    assert row.reason is None and row.evidence is None


def test_untouched_alerts_stay(spark):
    got = al.upsert(alerts(spark, alert("a"), alert("z", status="RESOLVED")), events(spark, event(1), event(2, "b")))
    assert {(r.id, r.status) for r in got.collect()} == {("a", "ACTIVE"), ("b", "ACTIVE"), ("z", "RESOLVED")}


def test_screening(spark):
    rows = events(
        spark, event(1), event(2, None), event(3, station=None), event(4, station="nowhere"), event(5, triggered=None)
    )
    got = {r.seq: r.reject_reason for r in al.screen_events(rows, stations(spark, "s1")).collect()}
    assert got == {
        1: None, 2: "missing id/stationId", 3: "missing id/stationId", 4: "unknown station", 5: "missing triggeredAt",
    }


@pytest.mark.parametrize("text, parsed", [
    ("high", "HIGH"), ("CRITICAL", "CRITICAL"), ("info", "INFO"), (None, "WARNING"), ("", "WARNING"),
    (" ", "WARNING"), ("bogus", "WARNING"), (" HIGH", "WARNING"),
])
def test_severity(spark, text, parsed):
    row = spark.createDataFrame([(text,)], "s string").select(parse_severity(F.col("s")).alias("p")).first()
    assert row.p == parsed


@pytest.mark.parametrize("text, parsed", [(None, "ONLINE"), (" ", "ONLINE"), ("stale", "STALE"), ("bogus", None)])
def test_station_status(spark, text, parsed):
    row = spark.createDataFrame([(text,)], "s string").select(parse_station_status(F.col("s")).alias("p")).first()
    assert row.p == parsed


# ---- commands

def commands(spark, *rows):
    return spark.createDataFrame([(i, a, at(m), None, n) for n, (i, a, m) in enumerate(rows)], COMMAND)


ACK, RES = "ACKNOWLEDGE", "RESOLVE"


@pytest.mark.parametrize("stored, asked, status, ack, resolved, reasons", [
    ("ACTIVE", [(ACK, 1), (RES, 2)], "RESOLVED", 1, 2, [None, None]),
    ("ACTIVE", [(RES, 1)], "RESOLVED", None, 1, [None]),
    ("ACTIVE", [(ACK, 1), (ACK, 2)], "ACKNOWLEDGED", 1, None, [None, al.NOT_ACTIVE]),
    ("ACTIVE", [(RES, 1), (ACK, 2), (RES, 3)], "RESOLVED", None, 1, [None, al.NOT_ACTIVE, al.ALREADY_RESOLVED]),
    ("ACTIVE", [(RES, 2), (ACK, 1)], "RESOLVED", 1, 2, [None, None]),
    ("ACKNOWLEDGED", [(ACK, 9)], "ACKNOWLEDGED", 0, None, [al.NOT_ACTIVE]),
    ("RESOLVED", [(RES, 9), (ACK, 9)], "RESOLVED", 0, 0, [al.ALREADY_RESOLVED, al.NOT_ACTIVE]),
])
def test_commands(spark, stored, asked, status, ack, resolved, reasons):
    start = alerts(spark, alert(
        status=stored, ack=0 if stored != "ACTIVE" else None, resolved=0 if stored == "RESOLVED" else None
    ))
    after, audit = al.apply_commands(start, commands(spark, *[("a", c, m) for c, m in asked]))
    row = after.first()
    assert (row.status, row.acknowledged_at, row.resolved_at) == (
        status, None if ack is None else clock(ack), None if resolved is None else clock(resolved)
    )
    assert [r.reject_reason for r in audit.orderBy("seq").collect()] == reasons


def test_command_for_a_missing_alert(spark):
    after, audit = al.apply_commands(alerts(spark, alert()), commands(spark, ("zz", ACK, 1)))
    assert after.first().status == "ACTIVE"
    assert [(r.accepted, r.reject_reason) for r in audit.collect()] == [(False, "Alert not found")]


def test_commands_match_sequential_guards(spark):
    rng = random.Random(3)
    stored = [(f"a{i}", rng.choice(["ACTIVE", "ACKNOWLEDGED", "RESOLVED"])) for i in range(40)]
    asked = [(rng.choice(stored)[0], rng.choice([ACK, RES]), rng.randint(1, 30)) for _ in range(200)]
    status, accepted = dict(stored), {}
    for n, (i, action, _) in sorted(enumerate(asked), key=lambda c: (c[1][2], c[0])):
        ok = status[i] == "ACTIVE" if action == ACK else status[i] != "RESOLVED"
        accepted[n] = ok
        if ok:
            status[i] = "ACKNOWLEDGED" if action == ACK else "RESOLVED"
    after, audit = al.apply_commands(
        alerts(spark, *[alert(i, s) for i, s in stored]), commands(spark, *asked)
    )
    assert {r.id: r.status for r in after.collect()} == status
    assert {r.seq: r.accepted for r in audit.collect()} == accepted


def test_upgrade_and_insert(spark):
    old = alerts(spark, alert(minutes=3)).drop("last_occurred_at", "repeat_count")
    row = al.upgrade(old).first()
    assert (row.last_occurred_at, row.repeat_count) == (clock(3), 1)
    partly = alerts(spark, alert(count=4)).withColumn("last_occurred_at", F.lit(None).cast("timestamp"))
    assert al.upgrade(partly).first().repeat_count == 4
    assert al.insert(alerts(spark, alert("a")), alerts(spark, alert("b"))).count() == 2


# ---- the stored table

def test_alert_table_versions(spark, tmp_path):
    table, known = AlertTable(spark, str(tmp_path / "alerts")), stations(spark, "s1")
    assert table.read().count() == 0
    table.apply(0, events(spark, event(1, "a"), event(2, "b", triggered=24 * 60)), known)
    first = table.manifest()
    assert first["committed"] == {"": 0} and len(first["buckets"]) == 2
    table.apply(1, events(spark, event(3, "a", minutes=9, count=2)), known)
    second = table.manifest()
    # only the touched bucket was rewritten
    assert len(set(second["buckets"].items()) & set(first["buckets"].items())) == 1
    assert {(r.id, r.repeat_count) for r in table.read().collect()} == {("a", 2), ("b", 1)}
    table.apply(1, events(spark, event(3, "a", minutes=9, count=99)), known)
    assert table.manifest() == second
    # another run's batches begin at 0 again and are not taken for these
    table.apply(0, events(spark, event(4, "c")), known, run="next")
    assert {r.id for r in table.read().collect()} == {"a", "b", "c"}


def test_repeats_keep_one_row_across_midnight(spark, tmp_path):
    table, known = AlertTable(spark, str(tmp_path / "alerts")), stations(spark, "s1")
    table.apply(0, events(spark, event(1, "a", triggered=5)), known)
    table.apply(1, events(spark, event(2, "a", minutes=26 * 60, count=2, triggered=25 * 60)), known)
    rows = table.read().collect()
    assert [(r.id, r.triggered_at, r.repeat_count) for r in rows] == [("a", clock(5), 2)]


def test_repeats_without_a_trigger_time(spark, tmp_path):
    table, known = AlertTable(spark, str(tmp_path / "alerts")), stations(spark, "s1")
    untimed = lambda *rows: events(spark, *rows).withColumn(
        "triggered_at", F.when(F.col("seq") % 2 == 0, F.col("triggered_at")))
    # seq 1 comes before anything is known of a, seq 3 after it, seq 5 is of an unknown id
    batch = untimed(event(1, "a"), event(2, "a"), event(3, "a", minutes=7, count=3), event(5, "b"))
    turned = []
    keep = lambda rows: turned.append({(r.seq, r.reject_reason) for r in rows.collect()})
    table.apply(0, batch, known, rejects=keep)
    table.apply(1, untimed(event(7, "a", minutes=9, count=4)), known, rejects=keep)
    assert turned == [{(1, al.MISSING_TRIGGER), (5, al.MISSING_TRIGGER)}, set()]
    assert [(r.id, r.triggered_at, r.repeat_count) for r in table.read().collect()] == [("a", clock(0), 4)]


def test_unsound_commands(spark):
    asked = commands(spark, ("a", ACK, 1), ("a", "SNOOZE", 2), ("a", RES, 3)).withColumn(
        "at", F.when(F.col("action") != ACK, F.col("at")))
    after, verdicts = al.apply_commands(alerts(spark, alert("a")), asked)
    assert [(r.status, r.acknowledged_at) for r in after.collect()] == [("RESOLVED", None)]
    assert [r.reject_reason for r in verdicts.orderBy("seq").collect()] == [al.MISSING_TIME, al.UNKNOWN_ACTION, None]


def test_failed_attempt_is_repeated_whole(spark, tmp_path):
    table, known = AlertTable(spark, str(tmp_path / "alerts")), stations(spark, "s1")
    table.apply(0, events(spark, event(1, "a")), known)
    batch = events(spark, event(2, "a", minutes=9, count=2), event(3, "b"))
    asked = commands(spark, ("a", ACK, 10), ("b", RES, 11), ("b", ACK, 12))

    def fail(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.apply(1, batch, known, asked, fail)
    assert {(r.id, r.status, r.repeat_count) for r in table.read().collect()} == {("a", "ACTIVE", 1)}
    seen = []
    table.apply(1, batch, known, asked, lambda verdicts: seen.extend(verdicts.orderBy("seq").collect()))
    assert [r.accepted for r in seen] == [True, True, False]
    assert {(r.id, r.status, r.repeat_count) for r in table.read().collect()} == {
        ("a", "ACKNOWLEDGED", 2), ("b", "RESOLVED", 1)
    }


# ---- stations

def test_registration(spark):
    rows = spark.createDataFrame([
        (None, "C-1", "One", None, None, None, "stale", 1),
        (None, "C-1", "One again", None, None, None, None, 2),
        (None, "C-s1", "Taken", None, None, None, None, 3),
        (None, " ", "No code", None, None, None, None, 4),
        (None, "C-9", "Odd", None, None, None, "bogus", 5),
    ], "id string, station_code string, name string, river_name string, latitude double, longitude double, status string, seq long")
    got = {r.seq: r.outcome for r in st.registration_outcomes(stations(spark, "s1"), rows).collect()}
    assert got == {1: "REGISTERED", 2: "CONFLICT", 3: "CONFLICT", 4: "ERROR", 5: "ERROR"}
    table = st.register(stations(spark, "s1"), rows, F.lit(at(1))).filter("station_code = 'C-1'").first()
    assert (table.status, table.last_seen_at, table.created_at, table.name) == ("ONLINE", clock(1), clock(1), "One")
    assert len(table.id) == 36


def test_last_seen(spark):
    accepted = readings(spark, [reading(1, 9), reading(2, 3)])
    got = {r.id: r.last_seen_at for r in st.touch_last_seen(stations(spark, "s1", "s2"), accepted).collect()}
    assert got == {"s1": clock(3), "s2": None}
    ids = spark.createDataFrame([("s2",)], "id string")
    got = {r.id: r.last_seen_at for r in st.touch_now(stations(spark, "s1", "s2"), ids, F.lit(at(4))).collect()}
    assert got == {"s1": None, "s2": clock(4)}


# ---- views

def test_top_k_plans_and_ties(spark):
    table = readings(spark, [reading(i, (i * 7) % 40, float(i)) for i in range(200)])
    recent = views.recent(table, 5)
    assert "TakeOrderedAndProject" in recent._jdf.queryExecution().executedPlan().toString()
    assert [r.seq for r in recent.collect()] == sorted(
        range(200), key=lambda i: (-((i * 7) % 40), i)
    )[:5]
    ranked = views.recent_per_station(table, 4, salts=3)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r.seq for r in ranked.orderBy("rank").collect()] == [r.seq for r in recent.collect()][:4]


def test_latest_first_arrival_wins_ties(spark):
    table = readings(spark, [reading(1, 5, 1.0), reading(2, 5, 2.0), reading(3, 4, 3.0)])
    assert [r.seq for r in views.latest_per_station(table).collect()] == [1]


def test_cards_feed_and_names(spark):
    table = readings(spark, [reading(1, 5, 1.005, None), reading(2, 6, None, 0.25, station="ghost")])
    cards = {r.id: r.reading for r in views.station_cards(stations(spark, "s1", "s2"), table).collect()}
    assert cards == {"s1": "1.00 m water level, — mm/h rainfall", "s2": "No readings yet"}
    rows = views.feed(table, stations(spark, "s1")).collect()
    assert [(r.station_name, r.water_level, r.rainfall, r.flow_rate) for r in rows] == [
        ("ghost", "—", "0.3", "—"), ("Station s1", "1.00", "—", "—"),
    ]


def test_point_lookups(spark):
    table = readings(spark, [reading(1, 5), reading(2, 6)])
    assert views.by_event_id(table, "e2").first().seq == 2
    wanted = spark.createDataFrame([("e1",), ("e1",), ("zz",)], "event_id string")
    assert [r.event_id for r in views.existing_event_ids(table, wanted).collect()] == ["e1"]
    assert [r.seq for r in views.station_history(table, "s1").collect()] == [2, 1]
    assert views.alert_by_id(alerts(spark, alert("a"), alert("b")), "b").count() == 1
    assert views.station_by_code(stations(spark, "s1"), "C-s1").first().id == "s1"


def test_alert_lists_actions_and_counts(spark):
    table = alerts(
        spark, alert("a", minutes=1), alert("b", "ACKNOWLEDGED", ack=2, count=3), alert("c", "RESOLVED", resolved=2),
        alert("d", minutes=2),
    )
    assert [r.id for r in views.active_alerts(table).collect()] == ["d", "a"]
    assert len(views.station_alerts(table, "s1").collect()) == 4
    got = {r.id: (r.actions, r.repeat_text) for r in views.with_actions(table).collect()}
    assert got["a"] == (["acknowledge", "resolve"], None)
    assert got["b"] == (["resolve"], "seen 3 times") and got["c"] == ([], None)
    many = readings(spark, [reading(i, i) for i in range(130)])
    counts = {r.panel: r.n for r in views.panel_counts(stations(spark, "s1"), table, many).collect()}
    assert counts == {"stations": 1, "active_alerts": 2, "recent_measurements": 100}


def test_fixed_point_text_is_exact(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(1)
    values = [0.0, 1.005, 0.125, 0.375, 2.675, 1.115, 0.994999, 0.995, 12345.675, 0.05, 0.25]
    values += [round(rng.uniform(0, 30), 4) for _ in range(500)] + [rng.uniform(0, 3) for _ in range(200)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2):
        unit = Decimal(1).scaleb(-digits)
        got = [r.t for r in table.select(to_fixed(F.col("v"), digits).alias("t")).collect()]
        assert got == [str(Decimal(v).quantize(unit, ROUND_HALF_UP)) for v in values]


def test_json_entry_append(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("{}",), (None,)], "j string")
    got = [r.e for r in rows.select(with_json_entry(F.col("j"), "n", F.lit(2)).alias("e")).collect()]
    assert got == ['{"a":1,"n":2}', '{"n":2}', '{"n":2}']
