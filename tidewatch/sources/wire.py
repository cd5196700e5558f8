"""Encoding towards topics: wire projection, JSON values and station keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import iso_instant
from tidewatch.schemas import MEASUREMENT_FIELDS
from tidewatch.sources.decode import ALERT_WIRE, MEASUREMENT_WIRE


def to_wire_event(stored: DataFrame) -> DataFrame:
    """Stored measurement -> event fields only; row id, receive time and station graph stay behind."""
    return stored.select(*MEASUREMENT_FIELDS)


def _encode(df: DataFrame, wire: dict[str, tuple[str, str]], keep: list[str] | None) -> DataFrame:
    entries = []
    for name, (column, kind) in wire.items():
        value = F.col(column)
        if kind == "timestamp":
            value = iso_instant(value)
        elif kind == "json":
            value = F.try_parse_json(value)
        entries.append(value.alias(name))
    body = F.to_json(F.struct(*entries), {"ignoreNullFields": "false"})
    return df.select(*(keep or []), F.col("station_id").alias("key"), body.alias("value"))


def encode_measurements(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``key`` = station, ``value`` = JSON: the record layout of the measurements topic."""
    return _encode(events, MEASUREMENT_WIRE, keep)


def encode_alert_events(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``key`` = station or null, ``value`` = JSON: the record layout of the alerts topic."""
    return _encode(events, ALERT_WIRE, keep)
