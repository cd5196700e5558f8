import pytest

from tidewatch.config import SETTINGS, RuleConfig


def test_defaults():
    c = RuleConfig.from_env({})
    assert (c.level_high_m, c.rain_intense_mm_h, c.combined_level_m, c.combined_rain_mm_h) == (4.0, 20.0, 3.0, 15.0)
    assert (c.rising_m, c.rising_window_min, c.rising_slide_min) == (0.5, 15, 5)
    assert (c.spike_m, c.spike_warmup, c.spike_window_min) == (1.0, 3, 60)
    assert (c.stale_min, c.watermark_min, c.suppression_min) == (30, 5, 60)


def test_environment_then_properties_then_default():
    c = RuleConfig.from_env(
        {"RULE_SPIKE_THRESHOLD_M": "2.5", "RULE_STALE_TIMEOUT_MINUTES": " "},
        {"RULE_SPIKE_THRESHOLD_M": "9", "RULE_STALE_TIMEOUT_MINUTES": "7", "RULE_SPIKE_WARMUP_READINGS": "5"},
    )
    # a blank environment value is unset: the default, not the property
    assert (c.spike_m, c.stale_min, c.spike_warmup) == (2.5, 30, 5)


@pytest.mark.parametrize("key", [k for k, v in SETTINGS.values() if not isinstance(v, str)])
@pytest.mark.parametrize("value", ["0", "-1"])
def test_non_positive_values_fail_by_key(key, value):
    with pytest.raises(ValueError, match=key):
        RuleConfig.from_env({key: value})


def test_nan_unparsable_and_oversized_slide_fail():
    with pytest.raises(ValueError, match="RULE_SPIKE_THRESHOLD_M"):
        RuleConfig.from_env({"RULE_SPIKE_THRESHOLD_M": "nan"})
    with pytest.raises(ValueError, match="RULE_SPIKE_WARMUP_READINGS"):
        RuleConfig.from_env({"RULE_SPIKE_WARMUP_READINGS": "three"})
    with pytest.raises(ValueError, match="RULE_RISING_SLIDE_MINUTES"):
        RuleConfig.from_env({"RULE_RISING_SLIDE_MINUTES": "20"})
    with pytest.raises(ValueError, match="KAFKA_BOOTSTRAP_SERVERS"):
        RuleConfig(bootstrap_servers=" ")


def test_size_need_not_be_a_multiple_of_slide():
    assert RuleConfig(rising_window_min=10, rising_slide_min=4).rising_slide_ms == 240_000


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from tidewatch.session import shared_dir

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.rpartition(".")[2], d)), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("local[8]", dir="file:/w")) == "file:/w"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
