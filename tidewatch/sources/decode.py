"""Tolerant JSON decoding: a bad record becomes a labelled row, never a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import UUID_PATTERN, is_blank
from tidewatch.schemas import MEASUREMENT_FIELDS

PARSE_ERROR = "JSON parse error"
EMPTY = "empty record value"

# wire name -> (column, type)
MEASUREMENT_WIRE = {
    "eventId": ("event_id", "string"),
    "stationId": ("station_id", "string"),
    "observedAt": ("observed_at", "timestamp"),
    "waterLevelM": ("water_level_m", "double"),
    "rainfallMmPerHour": ("rainfall_mm_per_hour", "double"),
    "flowRateM3S": ("flow_rate_m3s", "double"),
    "schemaVersion": ("schema_version", "int"),
}

ALERT_WIRE = {
    "id": ("id", "string"),
    "stationId": ("station_id", "string"),
    "ruleCode": ("rule_code", "string"),
    "severity": ("severity", "string"),
    "status": ("status", "string"),
    "title": ("title", "string"),
    "reason": ("reason", "string"),
    "evidence": ("evidence", "json"),
    "triggeredAt": ("triggered_at", "timestamp"),
    "acknowledgedAt": ("acknowledged_at", "timestamp"),
    "resolvedAt": ("resolved_at", "timestamp"),
    "lastOccurredAt": ("last_occurred_at", "timestamp"),
    "repeatCount": ("repeat_count", "int"),
}


def _decode(raw: DataFrame, wire: dict[str, tuple[str, str]], value: str, uuids: list[str]) -> DataFrame:
    """Add the fields of ``wire`` and ``decode_error`` (null when the document is well formed).

    A field is read once as its type and once as text; the verdict then works on those columns. A blank string counts as null for everything but plain text, as
    lenient JSON mappers do.

    The document and its fields pass through one-element generators: a filter on the verdict
    cannot be pushed below them, where it would repeat the parsing for every field it mentions.
    """
    read, defect = {}, F.lit(False)
    for name, (column, kind) in wire.items():
        path, document = f"$.{name}", F.col("_doc")
        text = F.try_variant_get(document, path, "string")
        read[column] = text if kind == "json" else F.try_variant_get(document, path, kind)
        if kind == "string":
            # text that looks like JSON may be a nested value or just such text
            shape = F.call_function("schema_of_variant", F.try_variant_get(document, path, "variant"))
            read[f"_nested_{column}"] = F.when(text.rlike(r"^[{\[]"), shape.rlike("^(OBJECT|ARRAY)"))
            defect = defect | F.coalesce(f"_nested_{column}", F.lit(False))
        elif kind != "json":
            read[f"_text_{column}"] = text
            text = F.col(f"_text_{column}")
            lost = F.col(column).isNull() & ~is_blank(text)
            # no flag is a number or a time
            defect = defect | F.coalesce(text.isin("true", "false") | lost, F.lit(False))
    for column in uuids:
        read[column] = F.lower(F.trim(read[column]))
        defect = defect | F.coalesce((F.col(column) != "") & ~F.col(column).rlike(UUID_PATTERN), F.lit(False))
    error = (
        F.when(F.col(value).isNull() | is_blank(F.col(value)), F.lit(EMPTY))
        .when(F.col("_unparsed") | ~F.ltrim(F.col(value)).startswith("{"), F.lit(PARSE_ERROR))
        .when(defect, F.lit(PARSE_ERROR))
    )
    fields = [column for column, _ in wire.values()]
    document = F.explode(F.array(F.try_parse_json(F.col(value)))).alias("_doc")
    opened = F.inline(F.array(F.struct(*[c.alias(name) for name, c in read.items()])))
    kept = [F.nullif(F.col(c), F.lit("")).alias(c) if c in uuids else F.col(c) for c in fields]
    return (
        raw.select("*", document)
        .select(*raw.columns, F.col("_doc").isNull().alias("_unparsed"), opened)
        .select(*raw.columns, *kept, error.alias("decode_error"))
    )


def validation_error() -> Column:
    """First failing required-field or sign check of a decoded measurement; null when sound."""
    event_id, level, rain = F.col("event_id"), F.col("water_level_m"), F.col("rainfall_mm_per_hour")
    return (
        F.when(event_id.isNull() | is_blank(event_id), F.lit("missing eventId"))
        .when(F.col("station_id").isNull(), F.lit("missing stationId"))
        .when(F.col("observed_at").isNull(), F.lit("missing observedAt"))
        .when(F.col("schema_version").isNull(), F.lit("missing schemaVersion"))
        .when(level < 0, F.lit("negative waterLevelM"))
        .when(rain < 0, F.lit("negative rainfallMmPerHour"))
    )


def decode_measurements(raw: DataFrame, value: str = "value", check_uuid: bool = True) -> DataFrame:
    """Decode JSON measurements; adds the measurement fields and ``error`` (null when valid).

    ``check_uuid=False`` accepts any scalar station id.
    """
    decoded = _decode(raw, MEASUREMENT_WIRE, value, ["station_id"] if check_uuid else [])
    return decoded.withColumn(
        "error", F.coalesce(F.col("decode_error"), validation_error())
    ).drop("decode_error")


def valid(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.filter(F.col("error").isNull()).drop("error", value)


def malformed(decoded: DataFrame, value: str = "value") -> DataFrame:
    """Quarantine rows: source columns, error, payload and the combined side-record text."""
    carried = [c for c in decoded.columns if c not in MEASUREMENT_FIELDS and c not in ("error", value)]
    raw = F.coalesce(F.col(value), F.lit("null"))
    return decoded.filter(F.col("error").isNotNull()).select(
        *carried,
        "error",
        F.col(value).alias("raw"),
        F.concat(F.lit("malformed measurement: "), F.col("error"), F.lit(" | raw="), raw).alias("record"),
    )


def decode_alert_events(raw: DataFrame, value: str = "value", check_uuid: bool = True) -> DataFrame:
    """Decode JSON alert events; ``error`` marks records persistence has to skip."""
    decoded = _decode(raw, ALERT_WIRE, value, ["id", "station_id"] if check_uuid else [])
    return decoded.withColumnRenamed("decode_error", "error")


