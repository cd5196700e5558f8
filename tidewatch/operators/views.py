"""Read queries over stations, measurements and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import epoch_ms, to_fixed
from tidewatch.schemas import ACKNOWLEDGED, ACTIVE, ALERT_FIELDS, MEASUREMENT_FIELDS

# How many rows the recent-reading reports show.
RECENT, RECENT_PER_STATION, FEED = 100, 50, 30
DASH = "—"


def _newest_first() -> list[Column]:
    """Newest event time first; arrival order settles ties."""
    return [F.col("observed_at").desc(), F.col("seq").asc()]


def reading_output(readings: DataFrame) -> DataFrame:
    """Stored readings as shown to callers: the submitted fields, without row id and receive time."""
    return readings.select(*MEASUREMENT_FIELDS)


def alert_output(alerts: DataFrame) -> DataFrame:
    """Alert rows as shown to callers."""
    return alerts.select(*ALERT_FIELDS)


def station_by_id(stations: DataFrame, station_id: str) -> DataFrame:
    return stations.filter(F.col("id") == station_id)


def station_by_code(stations: DataFrame, code: str) -> DataFrame:
    return stations.filter(F.col("station_code") == code)


def recent(readings: DataFrame, limit: int = RECENT) -> DataFrame:
    """Most recent readings over all stations: a top-k per partition, then one merge."""
    return readings.orderBy(*_newest_first()).limit(limit)


def recent_of_station(readings: DataFrame, station_id: str, limit: int = RECENT_PER_STATION) -> DataFrame:
    return recent(readings.filter(F.col("station_id") == station_id), limit)


def recent_per_station(readings: DataFrame, limit: int = RECENT_PER_STATION, salts: int = 64) -> DataFrame:
    """Most recent readings of every station, with their rank.

    Ranked per (station, salt) first: Spark cuts each group before the shuffle, and a hot station's
    survivors meet in ``salts`` tasks before at most salts x limit rows meet in one.
    """
    salted = Window.partitionBy("station_id", "_salt").orderBy(*_newest_first())
    whole = Window.partitionBy("station_id").orderBy(*_newest_first())
    return (
        readings.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(salted))
        .filter(F.col("_rank") <= limit)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= limit)
        .drop("_salt", "_rank")
    )


def station_history(readings: DataFrame, station_id: str) -> DataFrame:
    return readings.filter(F.col("station_id") == station_id).orderBy(*_newest_first())


def by_event_id(readings: DataFrame, event_id: str) -> DataFrame:
    return readings.filter(F.col("event_id") == event_id)


def existing_event_ids(readings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which of the wanted event ids are stored."""
    return wanted.select("event_id").distinct().join(readings.select("event_id"), "event_id", "left_semi")


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") == ACTIVE).orderBy(F.col("triggered_at").desc(), "id")


def station_alerts(alerts: DataFrame, station_id: str) -> DataFrame:
    return alerts.filter(F.col("station_id") == station_id).orderBy(F.col("triggered_at").desc(), "id")


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("id") == alert_id)


def latest_per_station(readings: DataFrame) -> DataFrame:
    """Each station's newest reading, first arrival on equal times; merged before the shuffle."""
    row = F.struct(*readings.columns)
    order = F.struct(epoch_ms("observed_at"), -F.col("seq"))
    return readings.groupBy("station_id").agg(F.max_by(row, order).alias("_row")).select("_row.*")


def station_cards(stations: DataFrame, readings: DataFrame) -> DataFrame:
    """Every station with its latest reading, or ``No readings yet``."""
    latest = latest_per_station(readings.select(
        "station_id", "observed_at", "water_level_m", "rainfall_mm_per_hour", "seq"
    )).withColumnRenamed("station_id", "id")
    joined = stations.join(latest.drop("seq"), "id", "left")
    text = F.when(F.col("observed_at").isNull(), F.lit("No readings yet")).otherwise(F.concat(
        fixed_or_dash("water_level_m", 2), F.lit(" m water level, "),
        fixed_or_dash("rainfall_mm_per_hour", 1), F.lit(" mm/h rainfall"),
    ))
    return joined.select(
        "id", "station_code", "name", "river_name", "status", "observed_at",
        "water_level_m", "rainfall_mm_per_hour", text.alias("reading"),
    )


def with_station_name(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Add ``station_name``, falling back to the raw id."""
    names = stations.select(F.col("id").alias("station_id"), F.col("name").alias("_name"))
    return (
        rows.join(names, "station_id", "left")
        .withColumn("station_name", F.coalesce("_name", "station_id"))
        .drop("_name")
    )


def fixed_or_dash(column: str, digits: int) -> Column:
    return F.coalesce(to_fixed(F.col(column), digits), F.lit(DASH))


def feed(readings: DataFrame, stations: DataFrame, limit: int = FEED) -> DataFrame:
    """The newest readings as the dashboard prints them."""
    return with_station_name(recent(readings, limit), stations).select(
        "station_name",
        "observed_at",
        fixed_or_dash("water_level_m", 2).alias("water_level"),
        fixed_or_dash("rainfall_mm_per_hour", 1).alias("rainfall"),
        fixed_or_dash("flow_rate_m3s", 1).alias("flow_rate"),
        "event_id",
        "seq",
    ).orderBy(*_newest_first())


def with_actions(alerts: DataFrame) -> DataFrame:
    """Add the next allowed actions and the repeat text shown beside an alert."""
    actions = (
        F.when(F.col("status") == ACTIVE, F.array(F.lit("acknowledge"), F.lit("resolve")))
        .when(F.col("status") == ACKNOWLEDGED, F.array(F.lit("resolve")))
        .otherwise(F.array().cast("array<string>"))
    )
    repeats = F.when(
        F.col("repeat_count") > 1,
        F.concat(F.lit("seen "), F.col("repeat_count").cast("string"), F.lit(" times")),
    )
    return alerts.withColumns({"actions": actions, "repeat_text": repeats})


def panel_counts(stations: DataFrame, alerts: DataFrame, readings: DataFrame) -> DataFrame:
    """Row counts above the three panels: stations, active alerts, recent readings (at most 100)."""
    def counted(panel: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(panel).alias("panel"), "n")

    return (
        counted("stations", stations)
        .unionByName(counted("active_alerts", alerts.filter(F.col("status") == ACTIVE)))
        .unionByName(counted("recent_measurements", readings.select("seq").limit(RECENT)))
    )
