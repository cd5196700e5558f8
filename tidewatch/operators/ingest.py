"""Idempotent ingest: known stations, first arrival per event id, one outcome per submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.contracts import submission_errors

ACCEPTED, DUPLICATE, ERROR = "ACCEPTED", "DUPLICATE", "ERROR"

# The message of each outcome.
MESSAGES = {
    "accepted": "Measurement accepted for processing",
    "duplicate": "Measurement with this eventId already exists",
    "unknown": "Station not found",
    "invalid": "Validation failed",
}


def known_station(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings of registered stations.

    No broadcast hint: Spark broadcasts the stations while their measured size is under its
    threshold and otherwise sort-merge joins, where adaptive execution splits a hot station.
    """
    return readings.join(stations.select(F.col("id").alias("station_id")), "station_id", "left_semi")


def unknown_station(readings: DataFrame, stations: DataFrame) -> DataFrame:
    return readings.join(stations.select(F.col("id").alias("station_id")), "station_id", "left_anti")


def first_arrivals(readings: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per event id, the first by ``seq``; ids already in ``stored`` are left out.

    ``min_by`` aggregates before the shuffle, so any number of copies of one id shrinks to one row
    per input partition.
    """
    row = F.struct(*readings.columns)
    firsts = readings.groupBy("event_id").agg(F.min_by(row, "seq").alias("_row")).select("_row.*")
    if stored is None:
        return firsts
    return firsts.join(stored.select("event_id"), "event_id", "left_anti")


def outcomes(submissions: DataFrame, stations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Label every submission ACCEPTED / DUPLICATE / ERROR with its message and field errors.

    The station check precedes the duplicate check, so a rejected reading claims no event id.
    The accepted rows are found by partial aggregation to (event_id, first seq); labelling joins
    on both columns, which spreads even the copies of one event id over all tasks.
    """
    ids = stations.select(F.col("id").alias("station_id"), F.lit(True).alias("_known")).distinct()
    checked = submissions.withColumn("errors", submission_errors()).join(ids, "station_id", "left")
    eligible = (F.size("errors") == 0) & F.col("_known").isNotNull()
    firsts = checked.filter(eligible).groupBy("event_id").agg(F.min("seq").alias("seq"))
    if stored is not None:
        firsts = firsts.join(stored.select("event_id"), "event_id", "left_anti")
    labelled = checked.join(firsts.withColumn("_first", F.lit(True)), ["event_id", "seq"], "left")
    invalid, unknown = F.size("errors") > 0, F.col("_known").isNull()
    outcome = (
        F.when(invalid | unknown, F.lit(ERROR))
        .when(F.col("_first"), F.lit(ACCEPTED))
        .otherwise(F.lit(DUPLICATE))
    )
    message = (
        F.when(invalid, F.lit(MESSAGES["invalid"]))
        .when(unknown, F.lit(MESSAGES["unknown"]))
        .when(F.col("_first"), F.lit(MESSAGES["accepted"]))
        .otherwise(F.lit(MESSAGES["duplicate"]))
    )
    return labelled.select(
        *submissions.columns, outcome.alias("outcome"), message.alias("message"), "errors"
    )


def accepted(labelled: DataFrame) -> DataFrame:
    """Rows to store and publish."""
    return labelled.filter(F.col("outcome") == ACCEPTED).drop("outcome", "message", "errors")


def stamp_received(readings: DataFrame, at=None) -> DataFrame:
    """Ingestion time: one instant per batch unless the source brings its own."""
    return readings.withColumn("received_at", F.current_timestamp() if at is None else at)
