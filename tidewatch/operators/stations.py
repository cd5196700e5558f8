"""The station table: registration and last-seen maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import parse_station_status, stable_uuid
from tidewatch.operators.contracts import station_errors

REGISTERED, CONFLICT, ERROR = "REGISTERED", "CONFLICT", "ERROR"
FIELDS = [
    "id", "station_code", "name", "river_name", "latitude", "longitude", "status",
    "last_seen_at", "created_at",
]


def registration_outcomes(stations: DataFrame, submissions: DataFrame) -> DataFrame:
    """Label every submitted station REGISTERED / CONFLICT / ERROR.

    The first submission of a code (by ``seq``) that is not taken yet gets it.
    """
    checked = submissions.withColumn("errors", station_errors()).withColumn(
        "_status", parse_station_status(F.col("status"))
    )
    sound = (F.size("errors") == 0) & F.col("_status").isNotNull()
    winners = (
        checked.filter(sound)
        .groupBy("station_code")
        .agg(F.min("seq").alias("seq"))
        .join(stations.select("station_code"), "station_code", "left_anti")
        .withColumn("_won", F.lit(True))
    )
    labelled = checked.join(winners, ["station_code", "seq"], "left")
    outcome = (
        F.when(~sound, F.lit(ERROR)).when(F.col("_won"), F.lit(REGISTERED)).otherwise(F.lit(CONFLICT))
    )
    return labelled.select(*submissions.columns, outcome.alias("outcome"), "errors")


def register(stations: DataFrame, submissions: DataFrame, now: Column | None = None) -> DataFrame:
    """Station table after registration; new stations are ONLINE and seen now, whatever was sent."""
    now = F.current_timestamp() if now is None else now
    fresh = registration_outcomes(stations, submissions).filter(F.col("outcome") == REGISTERED).withColumns({
        "id": F.coalesce("id", stable_uuid(F.lit("station"), F.col("station_code"))),
        "status": F.lit("ONLINE"),
        "last_seen_at": now,
        "created_at": now,
    })
    return stations.select(*FIELDS).unionByName(fresh.select(*FIELDS))


def touch_last_seen(stations: DataFrame, accepted: DataFrame) -> DataFrame:
    """Set last seen to the event time of each station's last accepted arrival (may move back)."""
    seen = accepted.groupBy("station_id").agg(F.max_by("observed_at", "seq").alias("observed_at"))
    return with_last_seen(stations, seen)


def with_last_seen(stations: DataFrame, seen: DataFrame) -> DataFrame:
    """Stations with the times of ``seen(station_id, observed_at)``, one row per station."""
    times = seen.select(F.col("station_id").alias("id"), F.col("observed_at").alias("_seen"))
    return (
        stations.join(times, "id", "left")
        .withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at"))
        .select(*FIELDS)
    )


def touch_now(stations: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Set last seen of the listed stations to the processing clock."""
    now = F.current_timestamp() if now is None else now
    listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    return (
        stations.join(listed, "id", "left")
        .withColumn("last_seen_at", F.when(F.col("_listed"), now).otherwise(F.col("last_seen_at")))
        .select(*FIELDS)
    )
