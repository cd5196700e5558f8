"""Submission contracts: every failing field with its message, as a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import is_blank

# The default messages of the standard bean constraints.
NOT_BLANK = "must not be blank"
NOT_NULL = "must not be null"
NOT_NEGATIVE = "must be greater than or equal to 0"
POSITIVE = "must be greater than 0"


def _not_blank(column: str) -> Column:
    c = F.col(column)
    return F.when(c.isNull() | is_blank(c), F.lit(NOT_BLANK))


def _not_null(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit(NOT_NULL))


def _error_map(checks: dict[str, Column]) -> Column:
    entries = F.map_from_arrays(
        F.array(*[F.lit(name) for name in checks]), F.array(*checks.values())
    )
    return F.map_filter(entries, lambda _, message: message.isNotNull())


def submission_errors() -> Column:
    """``map<field, message>`` of all failures of a submitted measurement; empty when it passes."""
    level, rain = F.col("water_level_m"), F.col("rainfall_mm_per_hour")
    return _error_map({
        "eventId": _not_blank("event_id"),
        "stationId": _not_null("station_id"),
        "observedAt": _not_null("observed_at"),
        "waterLevelM": _not_null("water_level_m").when(~(level >= 0) | F.isnan(level), F.lit(NOT_NEGATIVE)),
        "rainfallMmPerHour": _not_null("rainfall_mm_per_hour").when(
            ~(rain >= 0) | F.isnan(rain), F.lit(NOT_NEGATIVE)
        ),
        "schemaVersion": _not_null("schema_version").when(
            F.col("schema_version") <= 0, F.lit(POSITIVE)
        ),
    })


def station_errors() -> Column:
    """``map<field, message>`` of all failures of a submitted station."""
    return _error_map({
        "stationCode": _not_blank("station_code"),
        "name": _not_blank("name"),
    })


def with_submission_errors(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("errors", submission_errors())
