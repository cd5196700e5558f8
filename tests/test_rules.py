import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import (
    MINUTE, T0_MS, at, baseline_model, candidates, ms_of, reading, readings, suppression_model, windows_model,
)
from tidewatch.config import RuleConfig
from tidewatch.functions.expr import epoch_ms
from tidewatch.functions.median import RollingMedian
from tidewatch.operators.arrival import key_chunks, previous_max
from tidewatch.operators.rising import _split_by_clock, late_readings, rising_candidates, rising_windows
from tidewatch.operators.rules import threshold_candidates
from tidewatch.operators.spike import lead_ins, spike_baseline, spike_candidates, spikes
from tidewatch.operators.stale import last_observed, stale_candidates, stale_gaps
from tidewatch.operators.suppression import OPEN_RUNS, alert_events_of, runs_left_open, suppress, tracked_runs


# ---- thresholds

@pytest.mark.parametrize("level, rain, fired", [
    (1.5, 2.0, []),
    (4.0, 0.0, ["LEVEL_HIGH"]),
    (3.99, 0.0, []),
    (1.0, 20.0, ["RAIN_INTENSE"]),
    (3.0, 5.0, []),
    (3.0, 15.0, ["LEVEL_AND_RAIN"]),
    (5.0, 25.0, ["LEVEL_HIGH", "RAIN_INTENSE", "LEVEL_AND_RAIN"]),
    (None, None, []),
    (None, 30.0, ["RAIN_INTENSE"]),
    (float("nan"), float("nan"), []),
])
def test_thresholds(spark, config, level, rain, fired):
    rows = threshold_candidates(readings(spark, [reading(1, 0, level, rain)]), config)
    assert [r.rule_code for r in rows.collect()] == fired


def test_threshold_texts(spark, config):
    rows = threshold_candidates(readings(spark, [reading(1, 0.0005, 5.125, 25.0)]), config).collect()
    assert [(r.severity, r.title, r.reason) for r in rows] == [
        ("HIGH", "Water level high", "Water level 5.13m >= 4.00m threshold"),
        ("WARNING", "Intense rainfall", "Rainfall 25.00mm/h >= 20.00mm/h threshold"),
        ("CRITICAL", "High water level with intense rainfall",
         "Water level 5.13m >= 3.00m and rainfall 25.00mm/h >= 15.00mm/h"),
    ]
    assert rows[0].evidence == (
        '{"stationId":"s1","eventTimestamp":"2026-09-26T10:00:00.030Z","waterLevelM":5.125,"thresholdM":4.0}'
    )
    assert list(json.loads(rows[1].evidence)) == ["stationId", "eventTimestamp", "rainfallMmPerHour", "thresholdMmPerHour"]
    assert list(json.loads(rows[2].evidence)) == [
        "stationId", "eventTimestamp", "waterLevelM", "levelThresholdM", "rainfallMmPerHour", "rainThresholdMmPerHour",
    ]


def test_thresholds_need_no_shuffle(spark, config):
    plan = threshold_candidates(readings(spark, [reading(1, 0, 5.0, 1.0)]), config)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


# ---- rising windows

def fired_windows(spark, config, rows):
    windows = rising_windows(readings(spark, rows), config, chunk_rows=2)
    return rising_candidates(windows, config).filter(F.col("seq") == T0_MS + 15 * MINUTE).collect()


@pytest.mark.parametrize("rows, fires", [
    ([(0, 2.0), (14.98, 2.5)], True),
    ([(0, 2.0), (14.98, 2.3)], False),
    ([(0, 3.0), (14.98, 1.0)], False),
    ([(3, 9.0)], False),
    ([(3, 2.0), (3, 9.0)], False),
    ([(1, 2.0), (12, 2.6), (12, 2.1)], True),
    ([(1, 2.0), (12, 2.1), (12, 2.6)], False),
    ([(1, 2.0), (1, 1.0), (12, 2.4)], False),
    ([(1, 2.0), (5, None), (14, 2.6)], True),
    ([(1, 2.0), (15, 9.0)], False),
])
def test_rise(spark, config, rows, fires):
    got = fired_windows(spark, config, [reading(i, m, lv) for i, (m, lv) in enumerate(rows)])
    assert bool(got) == fires


def test_rise_text(spark, config):
    row = fired_windows(spark, config, [reading(1, 0, 2.0), reading(2, 14, 2.75)])[0]
    assert row.reason == (
        "Water level rose 0.75m within window 2026-09-26T10:00:00Z to 2026-09-26T10:15:00Z (>= 0.50m threshold)"
    )
    assert list(json.loads(row.evidence)) == [
        "stationId", "eventTimestamp", "windowStart", "windowEnd", "earliestWaterLevelM", "earliestObservedAt",
        "latestWaterLevelM", "latestObservedAt", "riseM", "thresholdM",
    ]
    assert row.event_time == datetime(2026, 9, 26, 10, 14)


def disordered(n, seed, spread=50, stations=("s1", "s2")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minutes = max(0.0, i * 1.5 + rng.uniform(-spread, spread) * (rng.random() < 0.3))
        level = None if rng.random() < 0.05 else round(rng.uniform(0, 6), 2)
        station = stations[0] if rng.random() < 0.7 else rng.choice(stations)
        rows.append((i, round(minutes, 2), level, station))
    return rows


@pytest.mark.parametrize("size, slide, chunk", [(15, 5, 7), (10, 4, 1000), (6, 6, 16)])
def test_windows_match_sequential_model(spark, size, slide, chunk):
    config = RuleConfig(rising_window_min=size, rising_slide_min=slide)
    rows = disordered(150, size)
    table = readings(spark, [reading(i, m, lv, station=s) for i, m, lv, s in rows])
    model = windows_model(
        [(s, i, ms_of(at(m)), lv) for i, m, lv, s in rows], size * MINUTE, slide * MINUTE, config.watermark_ms
    )
    got = {
        (r.station_id, r.window_start_ms): ((r.earliest_ms, r.earliest_level_m), (r.latest_ms, r.latest_level_m))
        for r in rising_windows(table, config, chunk_rows=chunk).collect()
    }
    assert got == model


def test_late_readings_miss_every_window(spark, config):
    rows = [reading(1, 60), reading(2, 45), reading(3, 44.99), reading(4, 55), reading(5, 20)]
    # highest earlier event time 60, closed up to 55: the last window of 44.99 ends there
    got = {r.seq for r in late_readings(readings(spark, rows), config, chunk_rows=2).collect()}
    assert got == {3, 5}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_previous_max(spark, chunk):
    rng = random.Random(chunk)
    values = [(i, rng.choice([None, rng.randint(0, 99)])) for i in range(60)]
    before, high = {}, None
    for i, v in values:
        before[i] = high
        high = max([x for x in (high, v) if x is not None], default=None)
    # nothing is declared unaffected: every row gets the exact value
    table = spark.createDataFrame(values, "seq long, v long")
    settled, rest = previous_max(table, F.col("v"), "m", lambda low, high: F.lit(False), chunk)
    assert settled.count() == 0
    assert {r.seq: r.m for r in rest.collect()} == before


@pytest.mark.parametrize("width", [1, 4, 50, 10_000])
def test_chunks_of_a_key(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aaab"), seq) for seq in sorted(rng.sample(range(2000), 300))] + [("c", 5000), ("c", 90_000)]
    chunked, several = key_chunks(spark.createDataFrame(rows, "k string, seq long"), ["k"], width)
    found = chunked.collect()
    assert several == any(r.chunk for r in found)
    assert len(found) == len(rows)
    for k in "abc":
        chunks = [r.chunk for r in sorted((r for r in found if r.k == k), key=lambda r: r.seq)]
        assert chunks == sorted(chunks) and set(chunks) == set(range(chunks[-1] + 1))
        assert all(chunks.count(c) < 2 * width or width == 1 for c in chunks)


@pytest.mark.parametrize("group", [1, 2, 7])
def test_chunk_groups_carry_over(spark, monkeypatch, group):
    from tidewatch.operators import arrival

    monkeypatch.setattr(arrival, "GROUP_CHUNKS", group)
    table = spark.createDataFrame([(i, (i * 37) % 101) for i in range(90)], "seq long, v long")
    _, rest = previous_max(table, F.col("v"), "m", lambda low, high: F.lit(False), 3)
    got = {r.seq: r.m for r in rest.collect()}
    assert got == {i: max([(j * 37) % 101 for j in range(i)], default=None) for i in range(90)}


def test_punctual_stretches_are_not_shuffled_by_arrival(spark, config):
    rows = [reading(i, i * 0.5, 1.0) for i in range(40)] + [reading(40 + i, 20 + i * 0.5 - (i == 5) * 15, 1.0) for i in range(20)]
    settled, rest = _split_by_clock(readings(spark, rows), config, 10)
    assert {r.seq for r in settled.collect()} == {*range(40), *range(50, 60)}
    assert {r.seq for r in rest.collect()} == set(range(40, 50))


# ---- spike

@pytest.mark.parametrize("baseline, current, expected", [
    ([2.0, 2.1], 10.0, None),
    ([2.0, 2.1, 1.9, 2.05], 2.5, None),
    ([2.0, 2.1, 1.9, 2.05], 3.1, 2.025),
    ([3.0, 3.1, 2.9], 1.5, 3.0),
    ([2.0, 2.1, 2.2], None, None),
    ([2.0, 2.0, 2.0], 3.0, 2.0),
])
def test_spike(spark, config, baseline, current, expected):
    levels = [*baseline, current]
    table = readings(spark, [reading(i, i, lv) for i, lv in enumerate(levels)])
    fired = [r for r in spikes(spike_baseline(table, config, 2), config).collect() if r.seq == len(baseline)]
    assert [r.baseline_median_m for r in fired] == ([] if expected is None else [pytest.approx(expected)])


def test_spike_text(spark):
    config = RuleConfig(spike_window_min=90)
    table = readings(spark, [reading(i, i, lv) for i, lv in enumerate([3.0, 3.1, 2.9, 1.5])])
    row = spike_candidates(spikes(spike_baseline(table, config), config), config).first()
    assert row.reason == (
        "Water level 1.50m differs from 1h baseline median 3.00m by 1.50m (>= 1.00m threshold)"
    )
    assert json.loads(row.evidence) == {
        "stationId": "s1", "eventTimestamp": "2026-09-26T10:03:00Z", "waterLevelM": 1.5, "baselineMedianM": 3.0,
        "deltaM": -1.5, "thresholdM": 1.0, "baselineSampleCount": 3,
    }


def test_sample_exactly_at_the_window_edge_stays(spark, config):
    table = readings(spark, [reading(0, 0, 1.0), reading(1, 60, 2.0), reading(2, 120.001, 3.0)])
    got = {r.seq: r.baseline_count for r in spike_baseline(table, config).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_late_reading_sees_newer_samples_and_pruning_is_permanent(spark, config):
    table = readings(spark, [
        reading(0, 0, 1.0), reading(1, 100, 2.0), reading(2, 30, 3.0), reading(3, 31, 4.0), reading(4, 101, 5.0),
    ])
    got = {r.seq: (r.baseline_count, r.baseline_median_m) for r in spike_baseline(table, config, 2).collect()}
    # 0 left when 1 arrived; 2 and 3 see 1; 4 evicts both late ones
    assert got == {0: (0, None), 1: (0, None), 2: (1, 2.0), 3: (2, 2.5), 4: (1, 2.0)}


def test_nan_levels_stay_nan_and_sort_last(spark, config):
    table = readings(spark, [reading(i, i, lv) for i, lv in enumerate([1.0, float("nan"), 3.0, 3.2])])
    got = {r.seq: r for r in spike_baseline(table, config).collect()}
    assert got[1].level_m != got[1].level_m
    assert (got[3].baseline_count, got[3].baseline_median_m) == (3, 3.0)


@pytest.mark.parametrize("seed, chunk", [(1, 5), (2, 17), (3, 1000)])
def test_baseline_matches_sequential_model(spark, config, seed, chunk):
    rows = disordered(220, seed, spread=120)
    table = readings(spark, [reading(i, m, lv, station=s) for i, m, lv, s in rows])
    model = baseline_model(
        [(s, i, ms_of(at(m)), lv) for i, m, lv, s in rows if lv is not None], config.spike_window_ms
    )
    got = {
        (r.station_id, r.seq): (r.baseline_count, r.baseline_median_m)
        for r in spike_baseline(table, config, chunk).collect()
    }
    assert got == model


@pytest.mark.parametrize("seed, chunk, block", [(1, 4, 1), (2, 9, 3), (3, 16, 512), (4, 5, 2)])
def test_baseline_with_clocks_ahead(spark, config, monkeypatch, seed, chunk, block):
    from tidewatch.operators import spike

    monkeypatch.setattr(spike.lead_ins, "__defaults__", (block,))
    rng = random.Random(seed)
    rows = [(i, m + rng.choice([0] * 20 + [90, 300, 600_000]), lv, s) for i, m, lv, s in disordered(260, seed, spread=80)]
    table = readings(spark, [reading(i, m, lv, station=s) for i, m, lv, s in rows])
    model = baseline_model(
        [(s, i, ms_of(at(m)), lv) for i, m, lv, s in rows if lv is not None], config.spike_window_ms)
    got = {(r.station_id, r.seq): (r.baseline_count, r.baseline_median_m)
           for r in spike_baseline(table, config, chunk).collect()}
    assert got == model


def test_a_stalled_clock_gathers_no_station(spark, config):
    """One reading dated a year ahead, then thousands of ordinary ones, all behind its clock."""
    rows = [reading(0, 525_600, 1.0)] + [reading(i, i, 1.0) for i in range(1, 4000)]
    levels = readings(spark, rows).select(
        "station_id", "seq", epoch_ms("observed_at").alias("event_ms"), F.col("water_level_m").alias("level_m"))
    chunked, _ = key_chunks(levels, ["station_id"], 200)
    together = chunked.union(lead_ins(chunked, config.spike_window_ms).select(chunked.columns))
    sizes = [r["count"] for r in together.groupBy("station_id", "chunk").count().collect()]
    # a chunk's own rows, the hour before it and the one sample that stays
    assert len(sizes) == 20 and max(sizes) <= 200 + 61 + 1
    got = {r.seq: r.baseline_count for r in spike_baseline(readings(spark, rows), config, 200).collect()}
    assert got == {i: min(i, 61) for i in range(4000)}


def test_rolling_median_against_plain_lists():
    from statistics import median

    rng = random.Random(5)
    window, plain = RollingMedian(), []
    for step in range(6000):
        time = step + rng.randint(-40, 0)
        cutoff = time - rng.choice([30, 200])
        window.expire(cutoff)
        plain = [s for s in plain if s[0] >= cutoff]
        assert len(window) == len(plain)
        if plain:
            assert window.median() == median(v for _, v in plain)
        value = rng.choice([1.0, 2.0, rng.random() * 4])
        window.add(time, value)
        plain.append((time, value))
    assert len(window.low) + len(window.high) <= 2 * len(window) + 1024 + 1


# ---- stale

@pytest.mark.parametrize("arrivals, as_of, fires", [
    ([0, 29], 300, [59]),
    ([0], 180, [30]),
    ([0, 40], 100, [30, 70]),
    ([0, 30], 40, [30]),
    ([0, 29.9], 59, []),
    ([0, 10], None, []),
])
def test_stale(spark, config, arrivals, as_of, fires):
    table = readings(spark, [reading(i, -500 + i, None, received=m) for i, m in enumerate(arrivals)])
    end = None if as_of is None else F.lit(at(as_of))
    got = sorted(r.fire_ms for r in stale_gaps(table, config, end).collect())
    assert got == [ms_of(at(m)) for m in fires]


def test_stale_text_and_last_arrival(spark, config):
    table = readings(spark, [reading(1, 5, received=0), reading(2, 3, received=1)])
    assert last_observed(table).first().last_observed_at == datetime(2026, 9, 26, 10, 3)
    row = stale_candidates(stale_gaps(table, config, F.lit(at(99))), config).first()
    assert row.reason == (
        "No accepted reading for station in over 30 minutes (last observed: 2026-09-26T10:03:00Z)"
    )
    assert row.evidence == '{"stationId":"s1","lastObservedAt":"2026-09-26T10:03:00Z","staleTimeoutMinutes":30}'
    assert row.event_time == datetime(2026, 9, 26, 10, 31)


def test_stale_random_against_plain_gaps(spark, config):
    rng = random.Random(9)
    clock, rows = {"a": 0.0, "b": 0.0}, []
    for i in range(300):
        s = rng.choice("ab")
        clock[s] += rng.choice([1, 14.5, 29.99, 30, 31, 95])
        rows.append((i, s, clock[s]))
    table = readings(spark, [reading(i, 0, received=m, station=s) for i, s, m in rows])
    expected = set()
    for s in "ab":
        times = [m for _, k, m in rows if k == s]
        expected |= {(s, ms_of(at(x + 30))) for x, y in zip(times, times[1:]) if y - x >= 30 - 1e-9}
    got = {(r.station_id, r.fire_ms) for r in stale_gaps(table, config).collect()}
    assert got == expected


# ---- suppression

def events(spark, config, rows, chunk=2):
    got = suppress(candidates(spark, rows), config, chunk).orderBy("rule_code", "seq").collect()
    return [(r.rule_code, r.id, r.repeat_count, ms_of_naive(r.triggered_at), ms_of_naive(r.last_occurred_at)) for r in got]


def ms_of_naive(ts):
    from datetime import timezone

    return round(ts.replace(tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("minutes, counts", [
    ([0], [1]),
    ([0, 10], [1, 2]),
    ([0, 61], [1, 1]),
    ([0, 60], [1, 1]),
    ([0, 50, 100, 150], [1, 2, 3, 4]),
    ([0, -10, 55], [1, 2, 1]),
])
def test_suppression(spark, config, minutes, counts):
    got = events(spark, config, [("s1", "LEVEL_HIGH", m, i) for i, m in enumerate(minutes)])
    assert [g[2] for g in got] == counts
    ids = [g[1] for g in got]
    assert [a == b for a, b in zip(ids, ids[1:])] == [c > 1 for c in counts[1:]]


def test_rules_and_stations_are_independent(spark, config):
    got = events(spark, config, [("s1", "LEVEL_HIGH", 0, 1), ("s1", "RAIN_INTENSE", 0, 1), ("s2", "LEVEL_HIGH", 0, 2)])
    assert [g[2] for g in got] == [1, 1, 1] and len({g[1] for g in got}) == 3


def test_alert_event_fields(spark, config):
    row = suppress(candidates(spark, [("s1", "LEVEL_HIGH", 0, 1), ("s1", "LEVEL_HIGH", 5, 2)]), config).orderBy("seq").collect()[1]
    assert (row.status, row.severity, row.title, row.reason) == ("ACTIVE", "HIGH", "Water level high", "why")
    assert row.evidence == '{"stationId":"s1","repeatCount":2}'
    assert row.triggered_at == datetime(2026, 9, 26, 10, 0) and row.last_occurred_at == datetime(2026, 9, 26, 10, 5)
    assert row.acknowledged_at is None and len(row.id) == 36


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_suppression_matches_sequential_model(spark, config, chunk):
    rng = random.Random(chunk)
    rows = []
    for rule, scale in (("LEVEL_HIGH", 1), ("LEVEL_RISING_FAST", config.rising_slide_ms), ("STATION_STALE", config.stale_ms)):
        clock = 0.0
        for i in range(80):
            clock += rng.choice([1, 20, 59.9, 60, 75, -30])
            # one station holds most rows
            rows.append(("s1" if rng.random() < 0.8 else "s2", rule, round(clock, 2), (i * 2 + rng.randint(0, 1)) * scale))
    model = suppression_model([((s, r), q, ms_of(at(m))) for s, r, m, q in rows], config.suppression_ms)
    got = suppress(candidates(spark, rows), config, chunk).collect()
    assert len(got) == len(rows)
    first_of = {}
    for r in got:
        first, triggered, count = model[(r.station_id, r.rule_code), r.seq]
        assert (ms_of_naive(r.triggered_at), r.repeat_count) == (triggered, count)
        assert first_of.setdefault(r.id, (r.station_id, r.rule_code, first)) == (r.station_id, r.rule_code, first)
    assert len(set(first_of.values())) == len(first_of)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_suppression_from_batch_to_batch(spark, config, chunk):
    """Batches of any cut give what one replay of all rows gives."""
    rng = random.Random(chunk)
    rows = [(rng.choice(["hot"] * 5 + ["s1", "s2"]), rng.choice(["LEVEL_HIGH", "RAIN_INTENSE"]), i * 7 + rng.choice([0, -30, 90]), i)
            for i in range(240)]
    whole = {(r.id, r.seq, r.repeat_count, r.triggered_at) for r in suppress(candidates(spark, rows), config, chunk).collect()}
    open_runs, got = spark.createDataFrame([], OPEN_RUNS), set()
    for first, last in [(0, 1), (1, 90), (90, 90), (90, 100), (100, 240)]:
        tracked = tracked_runs(candidates(spark, rows[first:last]), config, chunk, open_runs)
        got |= {(r.id, r.seq, r.repeat_count, r.triggered_at) for r in alert_events_of(tracked).collect()}
        open_runs = spark.createDataFrame(runs_left_open(tracked, open_runs).collect(), OPEN_RUNS)
    assert got == whole
    assert open_runs.count() == len({r[:2] for r in rows})
