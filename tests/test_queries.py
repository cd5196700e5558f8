"""Every registered query next to its DuckDB counterpart, over whole tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry
from tidewatch.config import RuleConfig
from tidewatch.operators.rising import rising_windows
from tidewatch.operators.spike import spike_baseline
from tidewatch.operators.suppression import suppress
from tidewatch.operators.rules import threshold_candidates
from tidewatch.plans.catalog import QUERIES
from tidewatch.plans.oracle import ORACLE
from tidewatch.sources.events import measurements, scrambled

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def in_name_order(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def wanted(duck, name):
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    return sorted(columns), in_name_order(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns, rows = wanted(duck, name)
    assert sorted(df.columns) == columns
    assert in_name_order(df.columns, [tuple(r) for r in df.collect()]) == rows


def test_every_counterpart_has_a_query():
    assert set(ORACLE) == set(QUERIES)


def test_texts_of_every_rule(spark):
    rows = QUERIES["candidate_texts"](spark, SF).collect()
    assert all(r.reason and r.evidence_station == r.station_id for r in rows)
    # these few readings are too sparse for a warm baseline
    assert len({r.rule_code for r in rows}) == 5


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("chunk", [64, 1000])
def test_small_chunks_give_the_same_results(spark, duck, chunk):
    config, readings = RuleConfig(), scrambled(measurements(spark, SF))
    columns, rows = wanted(duck, "spike_baseline_disordered")
    got = spike_baseline(readings, config, chunk)
    assert in_name_order(got.columns, [tuple(r) for r in got.collect()]) == rows
    columns, rows = wanted(duck, "rising_windows_disordered")
    got = rising_windows(readings, config, chunk_rows=chunk)
    assert in_name_order(got.columns, [tuple(r) for r in got.collect()]) == rows
    events = suppress(threshold_candidates(readings, config), config, chunk).select("id", "seq", "repeat_count")
    counts = {(r[0], r[1], r[2]) for r in events.collect()}
    sql = ORACLE["suppressed_disordered"]
    assert counts == set(duck.execute(f"SELECT id, seq, repeat_count FROM ({sql})").fetchall())


def test_rise_windows_aggregate_without_sorting(spark):
    plan = rising_windows(measurements(spark, SF), RuleConfig())._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
