"""Rule configuration: defaults, environment lookup and fail-fast validation."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Configuration key and default of every setting.
SETTINGS = {
    "bootstrap_servers": ("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"),
    "measurements_topic": ("KAFKA_TOPIC_MEASUREMENTS", "river.measurements.v1"),
    "alerts_topic": ("KAFKA_TOPIC_ALERTS", "river.alerts.v1"),
    "consumer_group": ("KAFKA_CONSUMER_GROUP", "tidewatch"),
    "level_high_m": ("RULE_LEVEL_HIGH_THRESHOLD_M", 4.0),
    "rain_intense_mm_h": ("RULE_RAIN_INTENSE_THRESHOLD_MM_H", 20.0),
    "combined_level_m": ("RULE_LEVEL_AND_RAIN_LEVEL_THRESHOLD_M", 3.0),
    "combined_rain_mm_h": ("RULE_LEVEL_AND_RAIN_RAIN_THRESHOLD_MM_H", 15.0),
    "rising_m": ("RULE_RISING_RATE_THRESHOLD_M", 0.5),
    "rising_window_min": ("RULE_RISING_WINDOW_MINUTES", 15),
    "rising_slide_min": ("RULE_RISING_SLIDE_MINUTES", 5),
    "spike_m": ("RULE_SPIKE_THRESHOLD_M", 1.0),
    "spike_warmup": ("RULE_SPIKE_WARMUP_READINGS", 3),
    "spike_window_min": ("RULE_SPIKE_BASELINE_WINDOW_MINUTES", 60),
    "stale_min": ("RULE_STALE_TIMEOUT_MINUTES", 30),
    "watermark_min": ("WATERMARK_OUT_OF_ORDERNESS_MINUTES", 5),
    "suppression_min": ("ALERT_SUPPRESSION_WINDOW_MINUTES", 60),
}

MINUTE_MS = 60_000


def _default(name: str):
    return SETTINGS[name][1]


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds, windows and endpoints. Durations are whole minutes."""

    bootstrap_servers: str = _default("bootstrap_servers")
    measurements_topic: str = _default("measurements_topic")
    alerts_topic: str = _default("alerts_topic")
    consumer_group: str = _default("consumer_group")
    level_high_m: float = _default("level_high_m")
    rain_intense_mm_h: float = _default("rain_intense_mm_h")
    combined_level_m: float = _default("combined_level_m")
    combined_rain_mm_h: float = _default("combined_rain_mm_h")
    rising_m: float = _default("rising_m")
    rising_window_min: int = _default("rising_window_min")
    rising_slide_min: int = _default("rising_slide_min")
    spike_m: float = _default("spike_m")
    spike_warmup: int = _default("spike_warmup")
    spike_window_min: int = _default("spike_window_min")
    stale_min: int = _default("stale_min")
    watermark_min: int = _default("watermark_min")
    suppression_min: int = _default("suppression_min")

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            # `not value > 0` also turns NaN away
            if not isinstance(value, str) and not value > 0:
                raise ValueError(f"{SETTINGS[f.name][0]} must be > 0, was {value}")
        if self.rising_slide_min > self.rising_window_min:
            raise ValueError("RULE_RISING_SLIDE_MINUTES must not exceed RULE_RISING_WINDOW_MINUTES")
        if not self.bootstrap_servers.strip():
            raise ValueError("KAFKA_BOOTSTRAP_SERVERS must not be blank")

    @classmethod
    def from_env(
        cls,
        env: Mapping[str, str] | None = None,
        properties: Mapping[str, str] | None = None,
    ) -> RuleConfig:
        """Environment first, then ``properties`` (e.g. Spark conf entries), then the default.

        A blank value counts as unset and yields the default.
        """
        env = os.environ if env is None else env
        properties = {} if properties is None else properties
        chosen = {}
        for name, (key, default) in SETTINGS.items():
            text = env.get(key, properties.get(key))
            if text is not None and text.strip():
                try:
                    chosen[name] = type(default)(text)
                except ValueError as bad:
                    raise ValueError(f"{key} is not a valid {type(default).__name__}: {text!r}") from bad
        return cls(**chosen)

    @property
    def rising_window_ms(self) -> int:
        return self.rising_window_min * MINUTE_MS

    @property
    def rising_slide_ms(self) -> int:
        return self.rising_slide_min * MINUTE_MS

    @property
    def spike_window_ms(self) -> int:
        return self.spike_window_min * MINUTE_MS

    @property
    def stale_ms(self) -> int:
        return self.stale_min * MINUTE_MS

    @property
    def watermark_ms(self) -> int:
        return self.watermark_min * MINUTE_MS

    @property
    def suppression_ms(self) -> int:
        return self.suppression_min * MINUTE_MS
