"""The alert table: lifecycle-preserving upsert, operator commands, schema upgrade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import parse_severity
from tidewatch.schemas import ACKNOWLEDGED, ACTIVE, ALERT_FIELDS, RESOLVED

# Why an event or a command is turned away.
MISSING_ID = "missing id/stationId"
MISSING_TRIGGER = "missing triggeredAt"
UNKNOWN_STATION = "unknown station"
NOT_FOUND = "Alert not found"
NOT_ACTIVE = "Only active alerts can be acknowledged"
ALREADY_RESOLVED = "Alert is already resolved"
UNKNOWN_ACTION = "Unknown action"
MISSING_TIME = "missing command time"

ACKNOWLEDGE, RESOLVE = "ACKNOWLEDGE", "RESOLVE"

REFRESHED = [
    "rule_code", "severity", "title", "reason", "evidence", "last_occurred_at", "repeat_count",
]


def screen_events(events: DataFrame, stations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``reject_reason``: null for events that may be persisted.

    A missing id or station and an unregistered station are turned away; no station is invented. The
    trigger time may be missing only from repeats: of ids in ``stored``, or after an event of these that has it.
    """
    ids = stations.select(F.col("id").alias("station_id"), F.lit(True).alias("_known")).distinct()
    reason = (
        F.when(F.col("id").isNull() | F.col("station_id").isNull(), F.lit(MISSING_ID))
        .when(F.col("_known").isNull(), F.lit(UNKNOWN_STATION))
    )
    screened = (
        events.join(ids, "station_id", "left")
        .withColumn("reject_reason", reason)
        .select(*events.columns, "reject_reason")
    )
    if stored is None:
        untimed = F.col("reject_reason").isNull() & F.col("triggered_at").isNull()
        return screened.withColumn(
            "reject_reason", F.when(untimed, F.lit(MISSING_TRIGGER)).otherwise(F.col("reject_reason")))
    timed = screened.where("triggered_at IS NOT NULL AND reject_reason IS NULL")
    since = timed.groupBy("id").agg(F.min("seq").alias("_since")).union(
        stored.select("id", F.lit(-(1 << 63)).alias("_since"))).groupBy("id").agg(F.min("_since").alias("_since"))
    untimed = screened.where("triggered_at IS NULL").join(since, "id", "left").withColumn(
        "reject_reason",
        F.coalesce("reject_reason", F.when(F.col("_since").isNull() | (F.col("_since") > F.col("seq")), F.lit(MISSING_TRIGGER))))
    return screened.where("triggered_at IS NOT NULL").unionByName(untimed.select(*screened.columns))


def persistable(screened: DataFrame) -> DataFrame:
    return screened.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(screened: DataFrame) -> DataFrame:
    return screened.filter(F.col("reject_reason").isNotNull())


def collapse_events(events: DataFrame) -> DataFrame:
    """One row per alert id: the last arrival's fields and the first arrival's trigger and station.

    Partially aggregated, so redeliveries and repeats of one alert meet already merged.
    """
    fields = F.struct(
        "rule_code",
        parse_severity(F.col("severity")).alias("severity"),
        "title", "reason", "evidence",
        F.coalesce("last_occurred_at", "triggered_at").alias("last_occurred_at"),
        F.coalesce("repeat_count", F.lit(1)).alias("repeat_count"),
    )
    return (
        events.groupBy("id")
        .agg(
            F.max_by(fields, "seq").alias("_last"),
            F.min_by(
                F.struct("station_id", "triggered_at"), F.when(F.col("triggered_at").isNotNull(), F.col("seq"))
            ).alias("_first"),
        )
        .select("id", "_first.station_id", "_first.triggered_at", *[f"_last.{c}" for c in REFRESHED])
    )


def upsert(stored: DataFrame | None, events: DataFrame) -> DataFrame:
    """Alert table after persisting ``events``.

    New ids enter as ACTIVE whatever the event says. Known ids get the event's fields but keep
    station, trigger, status and both lifecycle stamps, so an operator's decision survives repeats
    and redelivery. The last arrival wins; applying the same events again changes nothing.
    """
    fresh = collapse_events(events)
    if stored is None:
        return fresh.select(
            *[_inserted(c) for c in ALERT_FIELDS]
        )
    s, e = stored.alias("s"), fresh.alias("e")
    known = F.col("s.id").isNotNull()
    touched = F.col("e.id").isNotNull()
    columns = []
    for c in ALERT_FIELDS:
        if c in REFRESHED:
            value = F.when(touched, F.col(f"e.{c}")).otherwise(F.col(f"s.{c}"))
        elif c == "status":
            value = F.when(known, F.col("s.status")).otherwise(F.lit(ACTIVE))
        elif c in ("acknowledged_at", "resolved_at"):
            value = F.col(f"s.{c}")
        elif c == "id":
            value = F.coalesce("s.id", "e.id")
        else:
            value = F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"e.{c}"))
        columns.append(value.alias(c))
    return s.join(e, F.col("s.id") == F.col("e.id"), "full_outer").select(*columns)


def _inserted(column: str) -> Column:
    if column == "status":
        return F.lit(ACTIVE).alias(column)
    if column in ("acknowledged_at", "resolved_at"):
        return F.lit(None).cast("timestamp").alias(column)
    return F.col(column)


def apply_commands(alerts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply operator commands in ``(at, seq)`` order: (new alert table, per-command audit).

    A command without a time or with an action other than the two is turned away with its own reason.

    The guards have a closed form per alert: the first resolve is the only accepted one, and the
    first acknowledge is accepted when it precedes that resolve. Stored RESOLVED accepts nothing,
    stored ACKNOWLEDGED no further acknowledge. Two partial aggregations, no per-row loop.
    """
    order = F.struct("at", "seq")
    ack = F.min(F.when(F.col("action") == ACKNOWLEDGE, order))
    resolve = F.min(F.when(F.col("action") == RESOLVE, order))
    sound = F.col("at").isNotNull() & F.coalesce(F.col("action").isin(ACKNOWLEDGE, RESOLVE), F.lit(False))
    asked = commands.where(sound).groupBy(F.col("alert_id").alias("id")).agg(ack.alias("_ack"), resolve.alias("_resolve"))
    joined = alerts.join(asked, "id", "left")
    resolving = (F.col("status") != RESOLVED) & F.col("_resolve").isNotNull()
    acking = (
        (F.col("status") == ACTIVE)
        & F.col("_ack").isNotNull()
        & (F.col("_resolve").isNull() | (F.col("_ack") < F.col("_resolve")))
    )
    decided = joined.withColumns({
        "_ack": F.when(acking, F.col("_ack")),
        "_resolve": F.when(resolving, F.col("_resolve")),
    })
    after = decided.withColumns({
        "status": F.when(F.col("_resolve").isNotNull(), F.lit(RESOLVED))
        .when(F.col("_ack").isNotNull(), F.lit(ACKNOWLEDGED))
        .otherwise(F.col("status")),
        "acknowledged_at": F.coalesce("_ack.at", "acknowledged_at"),
        "resolved_at": F.coalesce("_resolve.at", "resolved_at"),
    }).select(*ALERT_FIELDS)

    # one row per accepted command; the join on (alert, seq) spreads the commands of one alert
    accepted = decided.select(
        F.col("id").alias("alert_id"),
        F.explode(F.array_compact(F.array("_ack.seq", "_resolve.seq"))).alias("seq"),
        F.lit(True).alias("accepted"),
    )
    known = alerts.select(F.col("id").alias("alert_id"), F.lit(True).alias("_known"))
    audited = commands.join(accepted, ["alert_id", "seq"], "left").join(known, "alert_id", "left")
    why = F.when(
        F.col("accepted").isNull(),
        F.when(~F.coalesce(F.col("action").isin(ACKNOWLEDGE, RESOLVE), F.lit(False)), F.lit(UNKNOWN_ACTION))
        .when(F.col("at").isNull(), F.lit(MISSING_TIME))
        .when(F.col("_known").isNull(), F.lit(NOT_FOUND))
        .when(F.col("action") == ACKNOWLEDGE, F.lit(NOT_ACTIVE))
        .otherwise(F.lit(ALREADY_RESOLVED)),
    )
    audit = audited.select(
        *commands.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"), why.alias("reject_reason")
    )
    return after, audit


def upgrade(alerts: DataFrame) -> DataFrame:
    """Bring an alert table without repeat tracking to the current schema."""
    columns = {}
    if "last_occurred_at" not in alerts.columns:
        columns["last_occurred_at"] = F.col("triggered_at")
    else:
        columns["last_occurred_at"] = F.coalesce("last_occurred_at", "triggered_at")
    if "repeat_count" not in alerts.columns:
        columns["repeat_count"] = F.lit(1)
    else:
        columns["repeat_count"] = F.coalesce("repeat_count", F.lit(1))
    return alerts.withColumns(columns).select(*ALERT_FIELDS)


def insert(stored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Append ready-made alert rows as they are."""
    return stored.select(*ALERT_FIELDS).unionByName(alerts.select(*ALERT_FIELDS))
