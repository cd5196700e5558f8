"""tidewatch: sensor-stream alerting on Spark, as batch replay and as Structured Streaming."""
