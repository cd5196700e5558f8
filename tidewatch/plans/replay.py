"""Batch replay: readings in, alert events and the alert table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tidewatch.config import RuleConfig
from tidewatch.operators.alerts import persistable, screen_events, upsert
from tidewatch.operators.rising import rising_candidates, rising_windows
from tidewatch.operators.rules import threshold_candidates
from tidewatch.operators.spike import spike_baseline, spike_candidates, spikes
from tidewatch.operators.stale import stale_candidates, stale_gaps
from tidewatch.operators.suppression import suppress
from tidewatch.session import materialize


def all_candidates(
    readings: DataFrame,
    config: RuleConfig,
    as_of: Column | None = None,
    arrival_replay: bool = True,
) -> DataFrame:
    """Candidates of all six rules. ``readings`` must be free of duplicate event ids."""
    spiking = spikes(spike_baseline(readings, config), config)
    windows = rising_windows(readings, config, arrival_replay)
    return (
        threshold_candidates(readings, config)
        .unionByName(spike_candidates(spiking, config))
        .unionByName(rising_candidates(windows, config))
        .unionByName(stale_candidates(stale_gaps(readings, config, as_of), config))
    )


def alert_events(
    readings: DataFrame,
    config: RuleConfig,
    as_of: Column | None = None,
    arrival_replay: bool = True,
) -> DataFrame:
    """All candidates after suppression. Suppression reads its input twice, so it is written once."""
    candidates = materialize(all_candidates(readings, config, as_of, arrival_replay), "candidates")
    return suppress(candidates, config)


def alert_table(events: DataFrame, stations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Alert table after persisting the events of registered stations."""
    return upsert(stored, persistable(screen_events(events, stations)))
