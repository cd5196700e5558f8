"""DuckDB counterparts of the registered queries, over the same tables."""

from __future__ import annotations

MINUTE = 60_000

M = """m AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id % 10 AS VARCHAR) AS station_id,
         epoch_us(ts) // 1000 AS ms, value / CAST(25 AS DOUBLE) AS level,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(4 AS DOUBLE) AS rain, event_id AS seq
  FROM events)"""

# disturbed arrival order
D = M + """, d AS (
  SELECT * REPLACE ((seq + (seq * 7919) % 50) * 50 + 49 - (seq * 7919) % 50 AS seq) FROM m)"""

# some readings are dated ahead, by hours or by more than a year
B = D + f""", bad AS (
  SELECT * REPLACE (ms + CAST(CASE WHEN seq % 97 = 0 THEN 400 * 24 WHEN seq % 89 = 3 THEN 5 ELSE 0 END AS BIGINT) * {60 * MINUTE} AS ms) FROM d)"""

STATIONS = """stations AS (
  SELECT CAST(s_suppkey + 1 AS VARCHAR) AS id, 'ST-' || CAST(s_suppkey + 1 AS VARCHAR) AS station_code,
         s_name AS name FROM supplier)"""


def thresholds(source: str) -> str:
    return f"""threshold AS (
  SELECT station_id, 'LEVEL_HIGH' AS rule_code, 'HIGH' AS severity, 'Water level high' AS title,
         ms AS event_ms, seq FROM {source} WHERE level >= 4.0
  UNION ALL
  SELECT station_id, 'RAIN_INTENSE', 'WARNING', 'Intense rainfall', ms, seq FROM {source} WHERE rain >= 20.0
  UNION ALL
  SELECT station_id, 'LEVEL_AND_RAIN', 'CRITICAL', 'High water level with intense rainfall', ms, seq
  FROM {source} WHERE level >= 3.0 AND rain >= 15.0)"""


def windows(source: str) -> str:
    """Readings reach the windows still open at arrival; the first arrival wins a tie."""
    return f"""clocked AS (
  SELECT *, max(ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source}),
spread AS (
  SELECT station_id, ms, seq, level, ms - ms % {5 * MINUTE} - k * {5 * MINUTE} AS ws, pm
  FROM clocked, (VALUES (0), (1), (2)) AS t(k) WHERE level IS NOT NULL),
win AS (
  SELECT station_id, ws AS window_start_ms, ws + {15 * MINUTE} AS window_end_ms,
         min(ms) AS earliest_ms, first(level ORDER BY ms, seq) AS earliest_level_m,
         max(ms) AS latest_ms, first(level ORDER BY ms DESC, seq) AS latest_level_m
  FROM spread WHERE pm IS NULL OR ws + {15 * MINUTE} > pm - {5 * MINUTE}
  GROUP BY station_id, ws HAVING min(ms) < max(ms)),
rising AS (SELECT *, latest_level_m - earliest_level_m AS rise_m FROM win)"""


RISING_CANDIDATES = """rising_c AS (
  SELECT station_id, 'LEVEL_RISING_FAST' AS rule_code, 'HIGH' AS severity,
         'Water level rising fast' AS title, latest_ms AS event_ms, window_end_ms AS seq
  FROM rising WHERE rise_m >= 0.5)"""


def baseline(source: str) -> str:
    """A sample leaves for good at the first later arrival more than the window ahead of it."""
    return f"""placed AS (
  SELECT station_id, seq, ms, level, row_number() OVER (PARTITION BY station_id ORDER BY seq) AS pos
  FROM {source} WHERE level IS NOT NULL),
leaving AS (
  SELECT a.station_id, a.pos, a.level, min(b.pos) AS gone
  FROM placed a LEFT JOIN placed b
    ON a.station_id = b.station_id AND b.pos > a.pos AND b.ms > a.ms + {60 * MINUTE}
  GROUP BY a.station_id, a.pos, a.level),
gathered AS (
  SELECT i.station_id, i.seq, i.ms, i.level, list_sort(list(j.level) FILTER (j.level IS NOT NULL)) AS s
  FROM placed i LEFT JOIN leaving j
    ON i.station_id = j.station_id AND j.pos < i.pos AND (j.gone IS NULL OR i.pos < j.gone)
  GROUP BY i.station_id, i.seq, i.ms, i.level),
base AS (
  SELECT station_id, seq, ms AS event_ms, level AS level_m,
         CAST(coalesce(len(s), 0) AS INTEGER) AS baseline_count,
         (s[(len(s) + 1) // 2] + s[(len(s) + 2) // 2]) / CAST(2 AS DOUBLE) AS baseline_median_m
  FROM gathered),
spike AS (
  SELECT *, level_m - baseline_median_m AS delta_m FROM base
  WHERE baseline_count >= 3 AND abs(level_m - baseline_median_m) >= 1.0)"""


SPIKE_CANDIDATES = """spike_c AS (
  SELECT station_id, 'SENSOR_SPIKE' AS rule_code, 'WARNING' AS severity, 'Sensor reading spike' AS title,
         event_ms, seq FROM spike)"""

STALE = f"""arrivals AS (
  SELECT station_id, ms, lead(ms) OVER (PARTITION BY station_id ORDER BY seq) AS next_ms FROM m),
stale AS (
  SELECT station_id, ms + {30 * MINUTE} AS fire_ms, ms AS last_observed_ms FROM arrivals
  WHERE coalesce(next_ms >= ms + {30 * MINUTE}, (SELECT max(ms) FROM m) >= ms + {30 * MINUTE})),
stale_c AS (
  SELECT station_id, 'STATION_STALE' AS rule_code, 'WARNING' AS severity, 'Station not reporting' AS title,
         fire_ms AS event_ms, fire_ms AS seq FROM stale)"""

CANDIDATES = ",\n".join([
    M, thresholds("m"), windows("m"), RISING_CANDIDATES, baseline("m"), SPIKE_CANDIDATES, STALE,
    """cand AS (
  SELECT * FROM threshold UNION ALL SELECT * FROM rising_c
  UNION ALL SELECT * FROM spike_c UNION ALL SELECT * FROM stale_c)""",
])


def fixed(value: str) -> str:
    """Two decimals, halves away from zero, of the number as it is written."""
    return f"CAST(CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DECIMAL(30, 2)) AS VARCHAR)"


def iso(ms: str) -> str:
    return (f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({ms}) % 1000 = 0 THEN 'Z' "
            f"ELSE '.' || lpad(CAST(({ms}) % 1000 AS VARCHAR), 3, '0') || 'Z' END")


def texts(rule: str, source: str, seq: str, reason: str, **fields: str) -> str:
    """Reason and evidence fields of a rule, in one column order for all rules."""
    kinds = {
        "at": "VARCHAR", "water_level": "DOUBLE", "rainfall": "DOUBLE", "threshold": "DOUBLE",
        "rain_threshold": "DOUBLE", "window_start": "VARCHAR", "window_end": "VARCHAR", "earliest_at": "VARCHAR",
        "latest_at": "VARCHAR", "earliest_level": "DOUBLE", "latest_level": "DOUBLE", "change": "DOUBLE",
        "median": "DOUBLE", "number": "INTEGER",
    }
    columns = ", ".join(f"CAST({fields.get(n, 'NULL')} AS {kind}) AS {n}" for n, kind in kinds.items())
    return (f"SELECT station_id, '{rule}' AS rule_code, {seq} AS seq, {reason} AS reason, "
            f"station_id AS evidence_station, {columns} FROM {source}")


TEXTS = "\nUNION ALL ".join([
    texts("LEVEL_HIGH", "m WHERE level >= 4.0", "seq", f"'Water level ' || {fixed('level')} || 'm >= 4.00m threshold'",
          at=iso("ms"), water_level="level", threshold="4.0"),
    texts("RAIN_INTENSE", "m WHERE rain >= 20.0", "seq", f"'Rainfall ' || {fixed('rain')} || 'mm/h >= 20.00mm/h threshold'",
          at=iso("ms"), rainfall="rain", threshold="20.0"),
    texts("LEVEL_AND_RAIN", "m WHERE level >= 3.0 AND rain >= 15.0", "seq",
          f"'Water level ' || {fixed('level')} || 'm >= 3.00m and rainfall ' || {fixed('rain')} || 'mm/h >= 15.00mm/h'",
          at=iso("ms"), water_level="level", rainfall="rain", threshold="3.0", rain_threshold="15.0"),
    texts("LEVEL_RISING_FAST", "rising WHERE rise_m >= 0.5", "window_end_ms",
          f"'Water level rose ' || {fixed('rise_m')} || 'm within window ' || {iso('window_start_ms')} || ' to ' || "
          f"{iso('window_end_ms')} || ' (>= 0.50m threshold)'",
          at=iso("latest_ms"), threshold="0.5", window_start=iso("window_start_ms"), window_end=iso("window_end_ms"),
          earliest_at=iso("earliest_ms"), latest_at=iso("latest_ms"), earliest_level="earliest_level_m",
          latest_level="latest_level_m", change="rise_m"),
    texts("SENSOR_SPIKE", "spike", "seq",
          f"'Water level ' || {fixed('level_m')} || 'm differs from 1h baseline median ' || {fixed('baseline_median_m')} || "
          f"'m by ' || {fixed('abs(delta_m)')} || 'm (>= 1.00m threshold)'",
          at=iso("event_ms"), water_level="level_m", threshold="1.0", median="baseline_median_m", change="delta_m",
          number="baseline_count"),
    texts("STATION_STALE", "stale", "fire_ms",
          f"'No accepted reading for station in over 30 minutes (last observed: ' || {iso('last_observed_ms')} || ')'",
          at=iso("last_observed_ms"), number="30"),
])


def suppressed(source: str) -> str:
    return f"""gaps AS (
  SELECT *, event_ms - lag(event_ms) OVER (PARTITION BY station_id, rule_code ORDER BY seq) AS gap FROM {source}),
runs AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {60 * MINUTE} THEN 1 ELSE 0 END)
    OVER (PARTITION BY station_id, rule_code ORDER BY seq) AS run FROM gaps),
tracked AS (
  SELECT *, first_value(event_ms) OVER w AS triggered_ms,
         md5(station_id || '|' || rule_code || '|' || CAST(first_value(seq) OVER w AS VARCHAR)) AS h,
         CAST(row_number() OVER w AS INTEGER) AS repeat_count
  FROM runs WINDOW w AS (PARTITION BY station_id, rule_code, run ORDER BY seq)),
ev AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
           || '-' || substr(h, 21, 12) AS id,
         station_id, rule_code, severity, 'ACTIVE' AS status, title, triggered_ms,
         event_ms AS last_occurred_ms, repeat_count, seq FROM tracked)"""


EVENTS = CANDIDATES + ",\n" + suppressed("cand")

TABLE = EVENTS + ",\n" + STATIONS + """,
alerts AS (
  SELECT id, any_value(station_id) AS station_id, any_value(rule_code) AS rule_code,
         any_value(severity) AS severity, 'ACTIVE' AS status, any_value(title) AS title,
         any_value(triggered_ms) AS triggered_ms, arg_max(last_occurred_ms, seq) AS last_occurred_ms,
         arg_max(repeat_count, seq) AS repeat_count
  FROM ev WHERE station_id IN (SELECT id FROM stations) GROUP BY id)"""

ALERT = "id, station_id, rule_code, severity, status, title, triggered_ms, last_occurred_ms, repeat_count"

COMMANDED = TABLE + """,
commands AS (
  SELECT id || suffix AS alert_id, action, triggered_ms + delay * 1000 AS at_ms, CAST(n AS BIGINT) AS seq
  FROM alerts JOIN (VALUES
    (1, 'ACKNOWLEDGE', 60, 1, ''), (1, 'ACKNOWLEDGE', 60, 1, '-missing'), (2, 'RESOLVE', 60, 1, ''),
    (3, 'ACKNOWLEDGE', 60, 1, ''), (3, 'RESOLVE', 120, 2, ''), (3, 'ACKNOWLEDGE', 180, 3, ''),
    (4, 'RESOLVE', 60, 1, ''), (4, 'ACKNOWLEDGE', 90, 2, ''), (4, 'RESOLVE', 120, 3, '')
  ) AS c(kind, action, delay, n, suffix) ON triggered_ms % 5 = kind),
stamps AS (
  SELECT a.id, min(at_ms) FILTER (action = 'RESOLVE') AS resolved_ms,
         min(at_ms) FILTER (action = 'ACKNOWLEDGE') AS ack_ms
  FROM alerts a LEFT JOIN commands c ON a.id = c.alert_id GROUP BY a.id),
after AS (
  SELECT a.* EXCLUDE (status), resolved_ms,
         CASE WHEN resolved_ms IS NULL OR ack_ms < resolved_ms THEN ack_ms END AS acknowledged_ms
  FROM alerts a JOIN stamps s ON a.id = s.id),
commanded AS (
  SELECT *, CASE WHEN resolved_ms IS NOT NULL THEN 'RESOLVED' WHEN acknowledged_ms IS NOT NULL
    THEN 'ACKNOWLEDGED' ELSE 'ACTIVE' END AS status FROM after)"""

# events as submissions, some repeating an id or breaking the contract
SUBMISSIONS = M + """, sub AS (
  SELECT CASE WHEN seq % 37 = 0 THEN ' '
              ELSE CAST(seq - CASE WHEN seq % 10 = 3 THEN 1 WHEN seq % 10 = 8 THEN 3 ELSE 0 END AS VARCHAR)
         END AS event_id, station_id, ms, seq,
         CASE WHEN seq % 17 = 0 THEN NULL WHEN seq % 23 = 0 THEN -1.0::DOUBLE ELSE level END AS level,
         CASE WHEN seq % 19 = 0 THEN -0.5::DOUBLE ELSE rain END AS rain,
         CASE WHEN seq % 29 = 0 THEN 0 WHEN seq % 31 = 0 THEN NULL ELSE 1 END AS schema_version
  FROM m)"""

OUTCOMES = SUBMISSIONS + ", " + STATIONS + """,
checked AS (
  SELECT *, trim(event_id) = '' OR level IS NULL OR level < 0 OR rain < 0 OR schema_version IS NULL
            OR schema_version <= 0 AS invalid,
         station_id NOT IN (SELECT id FROM stations) AS unknown FROM sub),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, invalid OR unknown ORDER BY seq) AS rn FROM checked),
labelled AS (
  SELECT *, CASE WHEN invalid OR unknown THEN 'ERROR' WHEN rn = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS outcome,
         CASE WHEN invalid THEN 'Validation failed' WHEN unknown THEN 'Station not found'
              WHEN rn = 1 THEN 'Measurement accepted for processing'
              ELSE 'Measurement with this eventId already exists' END AS message FROM ranked)"""

RAW = M + """, parts AS (
  SELECT *, seq % 13 AS k FROM m),
raw AS (
  SELECT seq, k, station_id, ms, rain, CASE WHEN k = 11 THEN 2.5 ELSE level END AS level,
    CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN '   ' WHEN k = 2 THEN '{not json' WHEN k = 10 THEN '[1,2]'
    ELSE '{' || CASE WHEN k = 3 THEN '' ELSE '"eventId":"' || event_id || '",' END
      || CASE WHEN k = 4 THEN '' ELSE '"stationId":"' || station_id || '",' END
      || CASE WHEN k = 5 THEN '' ELSE '"observedAt":' || CAST(ms AS VARCHAR) || ',' END
      || CASE WHEN k = 6 THEN '' ELSE '"schemaVersion":1,' END
      || '"waterLevelM":' || CASE WHEN k = 7 THEN '-1.0' WHEN k = 9 THEN '{"a":1}' WHEN k = 11 THEN '"2.5"'
                                  ELSE CAST(level AS VARCHAR) END
      || ',"rainfallMmPerHour":' || CASE WHEN k = 8 THEN '-2' ELSE CAST(rain AS VARCHAR) END || '}' END AS value
  FROM parts),
verdicts AS (
  SELECT *, CASE
    WHEN value IS NULL OR trim(value) = '' THEN 'empty record value'
    WHEN NOT json_valid(value) THEN 'JSON parse error'
    WHEN json_type(value) <> 'OBJECT' THEN 'JSON parse error'
    WHEN json_type(value, '$.waterLevelM') IN ('OBJECT', 'ARRAY', 'BOOLEAN') THEN 'JSON parse error'
    WHEN json_extract_string(value, '$.eventId') IS NULL THEN 'missing eventId'
    WHEN json_extract_string(value, '$.stationId') IS NULL THEN 'missing stationId'
    WHEN json_extract_string(value, '$.observedAt') IS NULL THEN 'missing observedAt'
    WHEN json_extract_string(value, '$.schemaVersion') IS NULL THEN 'missing schemaVersion'
    WHEN TRY_CAST(json_extract_string(value, '$.waterLevelM') AS DOUBLE) < 0 THEN 'negative waterLevelM'
    WHEN TRY_CAST(json_extract_string(value, '$.rainfallMmPerHour') AS DOUBLE) < 0 THEN 'negative rainfallMmPerHour'
    ELSE 'valid' END AS verdict FROM raw)"""

REGISTRATIONS = STATIONS + """, asked AS (
  SELECT 'ST-' || CAST(c_custkey % 250 AS VARCHAR) AS station_code, c_name AS name,
         CAST(c_custkey AS BIGINT) AS seq, c_custkey % 31 = 0 OR c_custkey % 7 = 0 AS bad FROM customer),
winners AS (
  SELECT station_code, min(seq) AS seq FROM asked
  WHERE NOT bad AND station_code NOT IN (SELECT station_code FROM stations) GROUP BY station_code),
registered AS (
  SELECT a.*, CASE WHEN bad THEN 'ERROR' WHEN w.seq IS NOT NULL THEN 'REGISTERED' ELSE 'CONFLICT' END AS outcome
  FROM asked a LEFT JOIN winners w ON a.station_code = w.station_code AND a.seq = w.seq)"""

READING = "event_id, station_id, ms AS event_ms, level AS water_level_m, rain AS rainfall_mm_per_hour"
SLIM = "station_id, rule_code, severity, title, event_ms, seq"
WINDOW = (
    "station_id, window_start_ms, window_end_ms, earliest_ms, earliest_level_m, latest_ms, "
    "latest_level_m, rise_m"
)
BASE = "station_id, seq, event_ms, level_m, baseline_count, baseline_median_m"
LEVEL_TEXT = "coalesce(printf('%.2f', level), '—')"
# quarters tie at one digit; ties go up
RAIN_TEXT = "coalesce(printf('%.1f', floor(rain * 10 + 0.5) / 10), '—')"


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


ORACLE = {
    "threshold_candidates": select(M + ", " + thresholds("m"), f"SELECT {SLIM} FROM threshold"),
    "level_high": select(M, f"SELECT {READING} FROM m WHERE level >= 4.0"),
    "rain_intense": select(M, f"SELECT {READING} FROM m WHERE rain >= 20.0"),
    "level_and_rain": select(M, f"SELECT {READING} FROM m WHERE level >= 3.0 AND rain >= 15.0"),
    "ingest_validation": select(RAW, """
SELECT seq, verdict, CASE WHEN verdict = 'valid' THEN station_id END AS station_id,
       CASE WHEN verdict = 'valid' THEN ms END AS event_ms,
       CASE WHEN verdict = 'valid' THEN level END AS water_level_m,
       CASE WHEN verdict = 'valid' THEN rain END AS rainfall_mm_per_hour FROM verdicts"""),
    "malformed_by_error": select(RAW, """
SELECT verdict AS error, count(*) AS n FROM verdicts WHERE verdict <> 'valid' GROUP BY verdict"""),
    "submission_errors": select(SUBMISSIONS, """
SELECT seq, array_to_string([x FOR x IN [
  CASE WHEN trim(event_id) = '' THEN 'eventId: must not be blank' END,
  CASE WHEN rain < 0 THEN 'rainfallMmPerHour: must be greater than or equal to 0' END,
  CASE WHEN schema_version IS NULL THEN 'schemaVersion: must not be null'
       WHEN schema_version <= 0 THEN 'schemaVersion: must be greater than 0' END,
  CASE WHEN level IS NULL THEN 'waterLevelM: must not be null'
       WHEN level < 0 THEN 'waterLevelM: must be greater than or equal to 0' END]
  IF x IS NOT NULL], '; ') AS errors FROM sub"""),
    "dedup_first": select(M, """
SELECT CAST(seq // 3 AS VARCHAR) AS event_id, min(seq) AS seq, arg_min(station_id, seq) AS station_id,
       arg_min(ms, seq) AS event_ms, arg_min(level, seq) AS water_level_m FROM m GROUP BY seq // 3"""),
    "unknown_station": select(M + ", " + STATIONS, """
SELECT event_id, station_id, ms AS event_ms FROM m WHERE station_id NOT IN (SELECT id FROM stations)"""),
    "known_station": select(M + ", " + STATIONS, """
SELECT station_id, count(*) AS n FROM m WHERE station_id IN (SELECT id FROM stations) GROUP BY station_id"""),
    "ingest_outcomes": select(OUTCOMES, "SELECT seq, event_id, outcome, message FROM labelled"),
    "stored_measurements": select(OUTCOMES, """
SELECT event_id, station_id, ms AS event_ms, level AS water_level_m, rain AS rainfall_mm_per_hour,
       CAST(schema_version AS INTEGER) AS schema_version FROM labelled WHERE outcome = 'ACCEPTED'"""),
    "wire_round_trip": select(M, f"""
SELECT station_id AS key, {READING}, CAST(NULL AS DOUBLE) AS flow_rate_m3s,
       CAST(1 AS INTEGER) AS schema_version, CAST(NULL AS VARCHAR) AS error FROM m"""),
    "rising_windows": select(M + ", " + windows("m"), f"SELECT {WINDOW} FROM rising"),
    "rising_windows_disordered": select(D + ", " + windows("d"), f"SELECT {WINDOW} FROM rising"),
    "rising_alert_candidates": select(
        ", ".join([M, windows("m"), RISING_CANDIDATES]), f"SELECT {SLIM} FROM rising_c"
    ),
    "late_events": select(D + ", " + windows("d"), f"""
SELECT event_id, station_id, ms, pm AS prev_max_ms FROM clocked
WHERE ms - ms % {5 * MINUTE} + {15 * MINUTE} <= pm - {5 * MINUTE}"""),
    "spike_baseline": select(M + ", " + baseline("m"), f"SELECT {BASE} FROM base"),
    "spike_baseline_disordered": select(D + ", " + baseline("d"), f"SELECT {BASE} FROM base"),
    "spike_baseline_bad_clock": select(B + ", " + baseline("bad"), f"SELECT {BASE} FROM base"),
    "spike_alerts": select(M + ", " + baseline("m"), f"SELECT {BASE}, delta_m FROM spike"),
    "stale_alerts": select(M + ", " + STALE, "SELECT station_id, fire_ms, last_observed_ms FROM stale"),
    "last_observed": select(
        D, "SELECT station_id, arg_max(ms, seq) AS last_observed_ms FROM d GROUP BY station_id"
    ),
    "candidate_texts": select(CANDIDATES, TEXTS),
    "all_candidates": select(CANDIDATES, f"SELECT {SLIM} FROM cand"),
    "suppressed_alert_events": select(EVENTS, f"SELECT {ALERT}, seq FROM ev"),
    "alert_event_round_trip": select(
        EVENTS, f"SELECT {ALERT}, station_id AS key, CAST(NULL AS VARCHAR) AS error FROM ev"
    ),
    "suppressed_disordered": select(
        ", ".join([D, thresholds("d"), suppressed("threshold")]), f"SELECT {ALERT}, seq FROM ev"
    ),
    "stream_threshold_alerts": select(
        ", ".join([M, thresholds("m"), suppressed("threshold")]), f"SELECT {ALERT}, seq FROM ev"
    ),
    "stream_rising": select(", ".join([M, windows("m"), RISING_CANDIDATES]), f"""
SELECT {SLIM} FROM rising_c WHERE seq <= (SELECT max(ms) FROM m) - {5 * MINUTE}"""),
    "stream_ingest": select(RAW + ", " + STATIONS, """
SELECT seq, CASE WHEN verdict <> 'valid' THEN 'MALFORMED' WHEN unknown THEN 'ERROR'
                 WHEN rn = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS outcome,
       CASE WHEN verdict <> 'valid' THEN verdict WHEN unknown THEN 'Station not found'
            WHEN rn = 1 THEN 'Measurement accepted for processing'
            ELSE 'Measurement with this eventId already exists' END AS message
FROM (SELECT *, row_number() OVER (PARTITION BY seq // 2, verdict <> 'valid' OR unknown ORDER BY seq) AS rn
      FROM (SELECT *, station_id NOT IN (SELECT id FROM stations) AS unknown FROM verdicts))"""),
    "alerts_current": select(TABLE, f"SELECT {ALERT} FROM alerts"),
    "alerts_rejected": select(EVENTS + ", " + STATIONS, """
SELECT id, station_id, rule_code, seq, 'unknown station' AS reject_reason FROM ev
WHERE station_id NOT IN (SELECT id FROM stations)"""),
    "alerts_redelivered": select(TABLE, f"SELECT {ALERT} FROM alerts"),
    "severity_parse": """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'CRITICAL' WHEN event_type = 'click' THEN 'HIGH'
  ELSE 'WARNING' END AS severity FROM events""",
    "ack_resolve": select(COMMANDED, "SELECT id, status, acknowledged_ms, resolved_ms FROM commanded"),
    "command_audit": select(COMMANDED, """
SELECT alert_id, action, seq, ok AS accepted,
       CASE WHEN ok THEN NULL WHEN id IS NULL THEN 'Alert not found'
            WHEN action = 'ACKNOWLEDGE' THEN 'Only active alerts can be acknowledged'
            ELSE 'Alert is already resolved' END AS reject_reason
FROM (SELECT c.*, k.id, coalesce(at_ms = CASE action WHEN 'RESOLVE' THEN resolved_ms ELSE acknowledged_ms END, false) AS ok
      FROM commands c LEFT JOIN commanded k ON c.alert_id = k.id)"""),
    "alerts_upgrade": select(TABLE, f"""
SELECT * REPLACE (triggered_ms AS last_occurred_ms, CAST(1 AS INTEGER) AS repeat_count)
FROM (SELECT {ALERT} FROM alerts)"""),
    "station_last_seen": select(OUTCOMES, """
SELECT s.id, arg_max(l.ms, l.seq) AS last_seen_ms FROM stations s
LEFT JOIN (SELECT * FROM labelled WHERE outcome = 'ACCEPTED') l ON s.id = l.station_id GROUP BY s.id"""),
    "stations_register": select(REGISTRATIONS, "SELECT seq, station_code, outcome FROM registered"),
    "stations_after_register": select(REGISTRATIONS, """
SELECT station_code, name, 'ONLINE' AS status, false AS is_new FROM stations UNION ALL
SELECT station_code, name, 'ONLINE', true FROM registered WHERE outcome = 'REGISTERED'"""),
    "stations_all": select(STATIONS, "SELECT id, station_code, name, 'ONLINE' AS status FROM stations"),
    "station_lookup": select(STATIONS, """
SELECT id, station_code, name FROM stations WHERE id = '3' UNION ALL
SELECT id, station_code, name FROM stations WHERE station_code = 'ST-7'"""),
    "recent_100": select(M, f"SELECT {READING} FROM m ORDER BY ms DESC, seq LIMIT 100"),
    "recent_50_of_station": select(
        M, f"SELECT {READING} FROM m WHERE station_id = '3' ORDER BY ms DESC, seq LIMIT 50"
    ),
    "recent_50_per_station": select(M, f"""
SELECT * FROM (SELECT {READING}, CAST(row_number() OVER (PARTITION BY station_id ORDER BY ms DESC, seq) AS INTEGER) AS rank
FROM m) WHERE rank <= 50"""),
    "station_history": select(M, f"SELECT {READING} FROM m WHERE station_id = '3' ORDER BY ms DESC, seq"),
    "stored_event_ids": select(M, """
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS event_id FROM orders
WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT event_id FROM m)"""),
    "latest_per_station": select(M, f"""
SELECT {READING} FROM m QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ms DESC, seq) = 1"""),
    "station_cards": select(M + ", " + STATIONS, f"""
SELECT s.id, s.name, l.ms AS event_ms,
       CASE WHEN l.ms IS NULL THEN 'No readings yet'
            ELSE {LEVEL_TEXT} || ' m water level, ' || {RAIN_TEXT} || ' mm/h rainfall' END AS reading
FROM stations s LEFT JOIN (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ms DESC, seq) = 1) l
ON s.id = l.station_id"""),
    "feed_30": select(M + ", " + STATIONS, f"""
SELECT coalesce(s.name, f.station_id) AS station_name, f.ms AS event_ms, {LEVEL_TEXT} AS water_level,
       {RAIN_TEXT} AS rainfall, '—' AS flow_rate, f.event_id
FROM (SELECT * FROM m ORDER BY ms DESC, seq LIMIT 30) f LEFT JOIN stations s ON s.id = f.station_id"""),
    "named_readings": select(M + ", " + STATIONS, f"""
SELECT m.event_id, coalesce(s.name, m.station_id) AS station_name, {LEVEL_TEXT} AS water_level
FROM m LEFT JOIN stations s ON s.id = m.station_id"""),
    "active_alerts": select(COMMANDED, f"SELECT {ALERT} FROM commanded WHERE status = 'ACTIVE'"),
    "alert_output": select(COMMANDED, f"SELECT {ALERT}, acknowledged_ms, resolved_ms FROM commanded"),
    "reading_output": select(M, f"""
SELECT {READING}, CAST(NULL AS DOUBLE) AS flow_rate_m3s, CAST(1 AS INTEGER) AS schema_version FROM m"""),
    "station_alerts": select(COMMANDED, f"SELECT {ALERT} FROM commanded WHERE station_id = '3'"),
    "alert_actions": select(COMMANDED, """
SELECT id, status, CASE status WHEN 'ACTIVE' THEN 'acknowledge,resolve' WHEN 'ACKNOWLEDGED' THEN 'resolve'
       ELSE '' END AS actions,
       CASE WHEN repeat_count > 1 THEN 'seen ' || CAST(repeat_count AS VARCHAR) || ' times' END AS repeat_text
FROM commanded"""),
    "panel_counts": select(COMMANDED, """
SELECT 'stations' AS panel, count(*) AS n FROM stations UNION ALL
SELECT 'active_alerts', count(*) FROM commanded WHERE status = 'ACTIVE' UNION ALL
SELECT 'recent_measurements', least(count(*), 100) FROM m"""),
    "stored_between": select(M, f"""
SELECT {READING} FROM m WHERE ms >= epoch_ms(TIMESTAMP '2024-01-05') AND ms < epoch_ms(TIMESTAMP '2024-01-08')"""),
    "stream_last_seen": select(D + ", " + STATIONS, """
SELECT s.id, arg_max(d.ms, d.seq) AS last_seen_ms FROM stations s LEFT JOIN d ON s.id = d.station_id GROUP BY s.id"""),
    "stream_live_stations": select(M + ", " + STATIONS, """
SELECT seq, CASE WHEN known THEN 'ACCEPTED' ELSE 'ERROR' END AS outcome,
       CASE WHEN known THEN 'Measurement accepted for processing' ELSE 'Station not found' END AS message
FROM (SELECT seq, station_id IN (SELECT id FROM stations)
        AND (CAST(station_id AS INT) % 2 = 0 OR seq > (SELECT max(seq) FROM m) // 2) AS known FROM m)"""),
    "stream_ingest_again": select(M + ", " + STATIONS, """
SELECT seq, CASE WHEN NOT known THEN 'ERROR' WHEN seq % 3 = 0 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS outcome,
       CASE WHEN NOT known THEN 'Station not found' WHEN seq % 3 = 0 THEN 'Measurement with this eventId already exists'
            ELSE 'Measurement accepted for processing' END AS message
FROM (SELECT seq, station_id IN (SELECT id FROM stations) AS known FROM m)"""),
    "alert_by_id": select(TABLE, f"SELECT {ALERT} FROM alerts WHERE id = (SELECT min(id) FROM alerts)"),
    "alerts_insert": select(TABLE, f"SELECT {ALERT} FROM alerts"),
    "station_touch_now": select(M + ", " + STATIONS, """
SELECT id, CASE WHEN id IN (SELECT station_id FROM m WHERE seq % 7 = 0) THEN (SELECT max(ms) FROM m) END AS last_seen_ms
FROM stations"""),
    "malformed_records": select(RAW, """
SELECT seq, verdict AS error, 'malformed measurement: ' || verdict AS head, value IS NOT NULL AS has_raw
FROM verdicts WHERE verdict <> 'valid'"""),
}
# the same results by another way
ORACLE.update({
    "stored_recent_100": ORACLE["recent_100"],
    "stored_recent_50_of_station": ORACLE["recent_50_of_station"],
    "stream_station_cards": ORACLE["station_cards"],
    "stream_alert_table": ORACLE["ack_resolve"],
    "stream_suppressed_chunks": ORACLE["stream_threshold_alerts"],
})
