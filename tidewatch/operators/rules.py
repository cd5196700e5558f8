"""Threshold rules on single readings, and the common candidate projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.functions.expr import iso_instant, json_object
from tidewatch.schemas import CANDIDATE_FIELDS, LEVEL_AND_RAIN, LEVEL_HIGH, RAIN_INTENSE, RULES


def reaches(value: Column, threshold: float) -> Column:
    """``value >= threshold``; null and NaN never do (Spark orders NaN above every number)."""
    return (value >= F.lit(float(threshold))) & ~F.isnan(value)


def level_high(config: RuleConfig) -> Column:
    return reaches(F.col("water_level_m"), config.level_high_m)


def rain_intense(config: RuleConfig) -> Column:
    return reaches(F.col("rainfall_mm_per_hour"), config.rain_intense_mm_h)


def level_and_rain(config: RuleConfig) -> Column:
    return reaches(F.col("water_level_m"), config.combined_level_m) & reaches(
        F.col("rainfall_mm_per_hour"), config.combined_rain_mm_h
    )


def as_candidates(
    fired: DataFrame, rule: Column | str, reason: Column, evidence: Column, event_time: Column
) -> DataFrame:
    """Project fired rows onto the candidate schema."""
    if isinstance(rule, str):
        severity, title = (F.lit(text) for text in RULES[rule])
        rule = F.lit(rule)
    else:
        severity = F.create_map(*[F.lit(x) for code in RULES for x in (code, RULES[code][0])])[rule]
        title = F.create_map(*[F.lit(x) for code in RULES for x in (code, RULES[code][1])])[rule]
    return fired.select(
        "station_id",
        rule.alias("rule_code"),
        severity.alias("severity"),
        title.alias("title"),
        reason.alias("reason"),
        evidence.alias("evidence"),
        event_time.alias("event_time"),
        "seq",
    ).select(*CANDIDATE_FIELDS)


def threshold_candidates(readings: DataFrame, config: RuleConfig) -> DataFrame:
    """One candidate per matched rule, in one narrow pass: no shuffle, no union of scans.

    Only the rule code is exploded; texts are built afterwards, so a consumer that does not need
    them never pays for them.
    """
    matched = readings.withColumn(
        "rule_code",
        F.explode(F.array_compact(F.array(
            F.when(level_high(config), F.lit(LEVEL_HIGH)),
            F.when(rain_intense(config), F.lit(RAIN_INTENSE)),
            F.when(level_and_rain(config), F.lit(LEVEL_AND_RAIN)),
        ))),
    )
    rule = F.col("rule_code")
    level, rain = F.col("water_level_m"), F.col("rainfall_mm_per_hour")
    high, intense = F.lit(config.level_high_m), F.lit(config.rain_intense_mm_h)
    both_level, both_rain = F.lit(config.combined_level_m), F.lit(config.combined_rain_mm_h)
    head = {"stationId": F.col("station_id"), "eventTimestamp": iso_instant(F.col("observed_at"))}
    reason = (
        F.when(rule == LEVEL_HIGH, F.format_string("Water level %.2fm >= %.2fm threshold", level, high))
        .when(
            rule == RAIN_INTENSE,
            F.format_string("Rainfall %.2fmm/h >= %.2fmm/h threshold", rain, intense),
        )
        .otherwise(F.format_string(
            "Water level %.2fm >= %.2fm and rainfall %.2fmm/h >= %.2fmm/h",
            level, both_level, rain, both_rain,
        ))
    )
    evidence = (
        F.when(rule == LEVEL_HIGH, json_object(**head, waterLevelM=level, thresholdM=high))
        .when(
            rule == RAIN_INTENSE,
            json_object(**head, rainfallMmPerHour=rain, thresholdMmPerHour=intense),
        )
        .otherwise(json_object(
            **head, waterLevelM=level, levelThresholdM=both_level,
            rainfallMmPerHour=rain, rainThresholdMmPerHour=both_rain,
        ))
    )
    return as_candidates(matched, rule, reason, evidence, F.col("observed_at"))
