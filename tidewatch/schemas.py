"""Fixed schemas of the tables and streams.

``seq`` is the arrival number of a row: unique, increasing in arrival order and reasonably dense
(a Kafka offset, an ingest counter). Spark keeps no row order across a shuffle, so arrival order
has to be a column.
"""

MEASUREMENT = (
    "event_id string, station_id string, observed_at timestamp, water_level_m double, "
    "rainfall_mm_per_hour double, flow_rate_m3s double, schema_version int, "
    "received_at timestamp, seq long"
)

MEASUREMENT_FIELDS = [
    "event_id", "station_id", "observed_at", "water_level_m",
    "rainfall_mm_per_hour", "flow_rate_m3s", "schema_version",
]

RAW = "seq long, key string, value string, received_at timestamp"

STATION = (
    "id string, station_code string, name string, river_name string, latitude double, "
    "longitude double, status string, last_seen_at timestamp, created_at timestamp"
)

CANDIDATE = (
    "station_id string, rule_code string, severity string, title string, reason string, "
    "evidence string, event_time timestamp, seq long"
)

CANDIDATE_FIELDS = [
    "station_id", "rule_code", "severity", "title", "reason", "evidence", "event_time", "seq",
]

ALERT = (
    "id string, station_id string, rule_code string, severity string, status string, title string, "
    "reason string, evidence string, triggered_at timestamp, acknowledged_at timestamp, "
    "resolved_at timestamp, last_occurred_at timestamp, repeat_count int"
)

ALERT_FIELDS = [
    "id", "station_id", "rule_code", "severity", "status", "title", "reason", "evidence",
    "triggered_at", "acknowledged_at", "resolved_at", "last_occurred_at", "repeat_count",
]

ALERT_EVENT = ALERT + ", seq long"

COMMAND = "alert_id string, action string, at timestamp, note string, seq long"

# Rule codes, severities and titles of the six rules.
LEVEL_HIGH = "LEVEL_HIGH"
RAIN_INTENSE = "RAIN_INTENSE"
LEVEL_AND_RAIN = "LEVEL_AND_RAIN"
LEVEL_RISING_FAST = "LEVEL_RISING_FAST"
SENSOR_SPIKE = "SENSOR_SPIKE"
STATION_STALE = "STATION_STALE"
RULES = {
    LEVEL_HIGH: ("HIGH", "Water level high"),
    RAIN_INTENSE: ("WARNING", "Intense rainfall"),
    LEVEL_AND_RAIN: ("CRITICAL", "High water level with intense rainfall"),
    LEVEL_RISING_FAST: ("HIGH", "Water level rising fast"),
    SENSOR_SPIKE: ("WARNING", "Sensor reading spike"),
    STATION_STALE: ("WARNING", "Station not reporting"),
}
SEVERITIES = ["INFO", "WARNING", "HIGH", "CRITICAL"]
STATION_STATUSES = ["ONLINE", "STALE", "OFFLINE"]
ACTIVE, ACKNOWLEDGED, RESOLVED = "ACTIVE", "ACKNOWLEDGED", "RESOLVED"
