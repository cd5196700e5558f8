"""Keyed state of the streaming form: baseline and silence per station, runs per condition; first arrivals of a batch.

Processors only keep state and emit plain facts; texts, ids and JSON are built by column
expressions on their output. Rows of a key come in no particular order within a micro-batch, so
they are sorted by arrival number there; a batch's size is bounded by the source's trigger limits.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.config import RuleConfig
from tidewatch.functions.median import RollingMedian
from tidewatch.schemas import SENSOR_SPIKE, STATION_STALE

STATION_FACT = (
    "station_id string, rule_code string, seq long, event_ms long, level_m double, "
    "baseline_count int, baseline_median_m double, delta_m double, last_observed_ms long"
)

RUN_FACT = (
    "station_id string, rule_code string, severity string, title string, reason string, "
    "evidence string, event_ms long, seq long, first_seq long, triggered_ms long, repeat_count int"
)
RUN_COLUMNS = [field.split()[0] for field in RUN_FACT.split(", ")]


class StationState(StatefulProcessor):
    """Rolling baseline (spike rule) and processing-time timer (stale rule) of one station."""

    def __init__(self, config: RuleConfig):
        self.window_ms = config.spike_window_ms
        self.warmup = config.spike_warmup
        self.threshold = config.spike_m
        self.stale_ms = config.stale_ms
        self.spike_rule, self.stale_rule = SENSOR_SPIKE, STATION_STALE

    def init(self, handle) -> None:
        self.handle = handle
        self.samples = handle.getListState("baseline", "event_ms long, level_m double")
        self.timer = handle.getValueState("stale_timer", "fire_ms long")
        self.last = handle.getValueState("last_observed", "event_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        station = key[0]
        baseline = RollingMedian()
        arrivals = [(s[0], s[1]) for s in self.samples.get()] if self.samples.exists() else []
        for ms, level in arrivals:
            baseline.add(ms, level)
        ordered = sorted(rows, key=lambda row: row.seq)
        for row in ordered:
            level = row.water_level_m
            if level is None:
                continue
            baseline.expire(row.event_ms - self.window_ms)
            size = len(baseline)
            if size >= self.warmup:
                median = baseline.median()
                # written so that NaN fires, as in the batch form
                if not abs(level - median) < self.threshold:
                    yield Row(
                        station_id=station, rule_code=self.spike_rule, seq=row.seq, event_ms=row.event_ms,
                        level_m=level, baseline_count=size, baseline_median_m=median,
                        delta_m=level - median, last_observed_ms=None,
                    )
            baseline.add(row.event_ms, level)
            arrivals.append((row.event_ms, level))
        kept = [arrivals[i] for i in sorted(baseline.side)]
        if kept:
            self.samples.put(kept)
        else:
            self.samples.clear()

        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        fire_ms = timerValues.getCurrentProcessingTimeInMs() + self.stale_ms
        self.handle.registerTimer(fire_ms)
        self.timer.update((fire_ms,))
        self.last.update((ordered[-1].event_ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fire_ms = expiredTimerInfo.getExpiryTimeInMs()
        # a newer reading may have re-armed the timer
        if not self.timer.exists() or self.timer.get()[0] != fire_ms:
            return
        self.timer.clear()
        yield Row(
            station_id=key[0], rule_code=self.stale_rule, seq=fire_ms, event_ms=fire_ms, level_m=None,
            baseline_count=None, baseline_median_m=None, delta_m=None,
            last_observed_ms=self.last.get()[0] if self.last.exists() else None,
        )

    def close(self) -> None:
        pass


class RunState(StatefulProcessor):
    """Open run of one (station, rule): first arrival, trigger, last occurrence and counter."""

    def __init__(self, config: RuleConfig):
        self.window_ms = config.suppression_ms

    def init(self, handle) -> None:
        self.run = handle.getValueState(
            "run", "first_seq long, triggered_ms long, last_ms long, repeat_count int"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Only arrival numbers and times of a key's rows are held; the rows wait in a temporary file, a block at a time."""
        with tempfile.TemporaryFile() as waiting:
            seqs, times = [], []
            for block in rows:
                pickle.dump(block, waiting)
                seqs.append(block["seq"].to_numpy())
                times.append(block["event_ms"].to_numpy())
            tracked = self.tracked(np.concatenate(seqs), np.concatenate(times))
            waiting.seek(0)
            done = 0
            for own in seqs:
                block, part = pickle.load(waiting), slice(done, done + len(own))
                done += len(own)
                yield block.assign(**{name: values[part] for name, values in tracked.items()})[RUN_COLUMNS]

    def tracked(self, seq: np.ndarray, ms: np.ndarray) -> dict[str, np.ndarray]:
        """The run of every row, in the order given; the state moves on to the last one."""
        first_seq, triggered, last, repeats = tuple(self.run.get()) if self.run.exists() else (0, 0, None, 0)
        order = np.argsort(seq, kind="stable")
        seq, ms, at = seq[order], ms[order], np.arange(len(order))
        opens = np.append(True if last is None else ms[0] - last >= self.window_ms, np.diff(ms) >= self.window_ms)
        start = np.maximum.accumulate(np.where(opens, at, -1))
        earlier = start < 0
        runs = {
            "first_seq": np.where(earlier, first_seq, seq[start]),
            "triggered_ms": np.where(earlier, triggered, ms[start]),
            "repeat_count": np.where(earlier, repeats + at + 1, at - start + 1),
        }
        self.run.update((int(runs["first_seq"][-1]), int(runs["triggered_ms"][-1]), int(ms[-1]), int(runs["repeat_count"][-1])))
        back = np.empty_like(order)
        back[order] = at
        return {name: values[back] for name, values in runs.items()}

    def close(self) -> None:
        pass


class KnownStation(StatefulProcessor):
    """Whether a station is registered; a row without a reading registers it."""

    def init(self, handle) -> None:
        self.registered = handle.getValueState("registered", "registered boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.registered.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, waiting = self.registered.exists(), []
        for row in rows:
            if row.reading is None:
                if not known:
                    self.registered.update((True,))
                known = True
            elif known:
                yield Row(reading=row.reading, known=True)
            else:
                # a registration may still follow
                waiting.append(row.reading)
        for reading in waiting:
            yield Row(reading=reading, known=known)

    def close(self) -> None:
        pass


# what a row stands for among those of an event id: an arrival, an id of the stored table, an id met for the first time
ARRIVAL, STORED_ID, NEW_ID = 0, 1, 2


def first_arrivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrivals of some event ids in a micro-batch with ``duplicate``: all but the first of a new id.

    Rows are ``event_id``, ``seq`` and others, the last column tells what they stand for. Of an id only the first
    arrival so far is held back, until all batches are seen.
    """
    new, stored, best = set(), set(), None
    for batch in batches:
        kind, rows = batch.column(batch.num_columns - 1), batch.select(batch.schema.names[:-1])
        for ids, which in ((new, NEW_ID), (stored, STORED_ID)):
            ids.update(rows.column("event_id").filter(pc.equal(kind, which)).to_pylist())
        rows = pa.Table.from_batches([rows.filter(pc.equal(kind, ARRIVAL))])
        rows = rows if best is None else pa.concat_tables([best, rows])
        if not rows.num_rows:
            continue
        ids = pa.array(rows.column("event_id").combine_chunks()).dictionary_encode().indices.to_numpy()
        order = np.lexsort((pc.fill_null(rows.column("seq"), sys.maxsize).to_numpy(), ids))
        first = np.zeros(len(order), dtype=bool)
        first[order[np.flatnonzero(np.diff(ids[order], prepend=-1))]] = True
        best = rows.filter(pa.array(first))
        yield from _labelled(rows.filter(pa.array(~first)), [True] * int((~first).sum()))
    if best is not None:
        yield from _labelled(best, [i not in new or i in stored for i in best.column("event_id").to_pylist()])


def _labelled(rows: pa.Table, duplicate: list[bool]) -> list[pa.RecordBatch]:
    return rows.append_column("duplicate", pa.array(duplicate, pa.bool_())).to_batches()


# ship this module inside serialized processors, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
