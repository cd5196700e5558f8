"""Fixture builders and sequential models the distributed operators are compared with."""

from datetime import datetime, timedelta, timezone
from statistics import median

from tidewatch.schemas import MEASUREMENT, RULES

T0 = datetime(2026, 9, 26, 10, 0, tzinfo=timezone.utc)
T0_MS = int(T0.timestamp() * 1000)
MINUTE = 60_000


def at(minutes=0.0, seconds=0.0):
    return T0 + timedelta(minutes=minutes, seconds=seconds)


def ms_of(ts):
    return round(ts.timestamp() * 1000)


def reading(seq, minutes, level=None, rain=None, station="s1", event_id=None, received=None):
    observed = at(minutes)
    return (
        event_id or f"e{seq}", station, observed, level, rain, None, 1,
        observed if received is None else at(received), seq,
    )


def readings(spark, rows):
    return spark.createDataFrame(rows, MEASUREMENT)


def candidates(spark, rows):
    """rows of (station, rule, minutes, seq)"""
    schema = (
        "station_id string, rule_code string, severity string, title string, reason string, "
        "evidence string, event_time timestamp, seq long"
    )
    return spark.createDataFrame(
        [(s, r, *RULES[r], "why", '{"stationId":"s1"}', at(m), q) for s, r, m, q in rows], schema
    )


def baseline_model(rows, window_ms):
    """(station, seq) -> (count, median) by walking one station's readings in arrival order."""
    result, buffers = {}, {}
    for station, seq, ms, level in sorted(rows, key=lambda r: r[1]):
        kept = [s for s in buffers.get(station, []) if s[0] >= ms - window_ms]
        levels = [lv for _, lv in kept]
        result[station, seq] = (len(levels), median(levels) if levels else None)
        buffers[station] = [*kept, (ms, level)]
    return result


def suppression_model(rows, window_ms):
    """(key, seq) -> (first seq, triggered ms, repeat count) in arrival order."""
    result, state = {}, {}
    for key, seq, ms in sorted(rows, key=lambda r: r[1]):
        run = state.get(key)
        if run is not None and ms - run[2] < window_ms:
            run = (run[0], run[1], ms, run[3] + 1)
        else:
            run = (seq, ms, ms, 1)
        state[key] = run
        result[key, seq] = (run[0], run[1], run[3])
    return result


def windows_model(rows, size, slide, delay):
    """(station, start) -> (earliest, latest) of (ms, level), late readings kept out."""
    highest, windows = None, {}
    for station, _seq, ms, level in sorted(rows, key=lambda r: r[1]):
        start = ms - ms % slide
        while start + size > ms:
            open_still = highest is None or start + size > highest - delay
            if open_still and level is not None:
                first, last = windows.get((station, start), (None, None))
                if first is None or ms < first[0]:
                    first = (ms, level)
                if last is None or ms > last[0]:
                    last = (ms, level)
                windows[station, start] = (first, last)
            start -= slide
        highest = ms if highest is None else max(highest, ms)
    return {k: v for k, v in windows.items() if v[0][0] < v[1][0]}
