"""Grid, durations, counters and quantiles on small series."""

import random

import numpy as np
import pytest

from fleetlens.operators import fleet, series
from fleetlens.plans import rules

S = 1_000_000
RULE = rules.Rule("Low", "m", "<", 15.0, 30, "critical", "ops", "", "")


def samples(spark, rows):
    return spark.createDataFrame([(d, int(t * S), float(v)) for d, t, v in rows], "drone_id string, sample_us bigint, value double")


def states(spark, rows, lookback_s=300, end_s=120, rule=RULE):
    grid = series.on_grid(samples(spark, rows), ["drone_id"], lookback_s=lookback_s, end_us=end_s * S)
    return {(r.drone_id, r.tick // S): r.state for r in rules.evaluate(grid, rule, ["drone_id"]).collect()}


def test_fires_at_exactly_for(spark):
    got = states(spark, [("d", 0, 10)], end_s=45)
    assert got == {("d", 0): "pending", ("d", 15): "pending", ("d", 30): "firing", ("d", 45): "firing"}


def test_a_false_tick_starts_over(spark):
    got = states(spark, [("d", 0, 10), ("d", 14, 20), ("d", 16, 10)], end_s=60)
    assert got == {("d", 0): "pending", ("d", 30): "pending", ("d", 45): "pending", ("d", 60): "firing"}


def test_gap_inside_and_past_lookback(spark):
    carried = states(spark, [("d", 0, 10), ("d", 60, 10)], lookback_s=61, end_s=60)
    assert carried[("d", 60)] == "firing" and len(carried) == 5
    absent = states(spark, [("d", 0, 10), ("d", 60, 10)], lookback_s=30, end_s=60)
    assert absent == {("d", 0): "pending", ("d", 15): "pending", ("d", 60): "pending"}


def test_long_alerts_and_durations(spark):
    """More ticks in a series, and more seconds to hold, than an int has microseconds for."""
    rows = [("d", t, 10) for t in range(0, 15 * 300, 15)]
    got = states(spark, rows, end_s=15 * 299, rule=rules.Rule("Low", "m", "<", 15.0, 3000, "critical", "ops", "", ""))
    assert got == {("d", t): "firing" if t >= 3000 else "pending" for t in range(0, 15 * 300, 15)}


def test_series_are_apart(spark):
    got = states(spark, [("a", 0, 10), ("b", 15, 10)], end_s=30)
    assert got[("a", 30)] == "firing" and got[("b", 30)] == "pending"


def test_zero_connected_counts_as_zero(spark):
    grid = series.on_grid(samples(spark, [("a", 0, 1), ("b", 0, 0), ("a", 60, 0)]), ["drone_id"], lookback_s=20, end_us=60 * S)
    counts = {r.tick // S: r.value for r in rules.connected_count(grid).collect()}
    assert counts == {0: 1.0, 15: 1.0, 30: 0.0, 45: 0.0, 60: 0.0}


def test_silent_drone_turns_disconnected(spark):
    rows = [(1, "d", "s", 0, True), (2, "d", "s", 100 * S, True), (3, "e", "s", 90 * S, True)]
    df = spark.createDataFrame(rows, "event_id bigint, drone_id string, swarm_id string, us bigint, connected boolean")
    got = sorted((r.drone_id, r.sample_us // S, r.value) for r in series.connected_samples(df).collect())
    assert got == [("d", 5, 1.0), ("d", 35, 0.0), ("d", 105, 1.0), ("e", 95, 1.0)]


def test_increase_survives_a_reset(spark):
    rows = [("d", t, v) for t, v in [(0, 5), (10, 8), (20, 2), (30, 2), (400, 3)]]
    got = {r.sample_us // S: r.increase for r in series.increase(samples(spark, rows), ["drone_id"]).collect()}
    assert got == {0: 0.0, 10: 3.0, 20: 5.0, 30: 5.0, 400: 1.0}


@pytest.mark.parametrize("last_s, active", [(70.1, 1), (70.0, 0)])
def test_activity_limit(spark, last_s, active):
    rows = [(1, "d", "a", int(last_s * S), 100.0, -40.0, 20.0, 1.0, True), (2, "e", "b", 0, 100.0, -40.0, 20.0, 1.0, True)]
    df = spark.createDataFrame(rows, "event_id bigint, drone_id string, swarm_id string, us bigint, battery_percent double, "
                                     "signal_dbm double, temperature_c double, altitude_m double, connected boolean")
    got = {r.swarm_id: (r.active_drones, r.health_score) for r in fleet.swarm_status(df, as_of_us=100 * S).collect()}
    assert got == {"a": (active, 1.0 if active else None), "b": (0, None)}


def test_absent_field_keeps_the_gauge(spark):
    rows = [(1, "d", "s", 0, 50.0, 1.0), (2, "d", "s", 1, None, 2.0)]
    df = spark.createDataFrame(rows, "event_id bigint, drone_id string, swarm_id string, us bigint, battery_percent double, altitude_m double")
    for name in fleet.GAUGES:
        if name not in df.columns:
            df = df.selectExpr("*", f"cast(null as double) as {name}")
    got = {r.metric: r.value for r in fleet.gauges(df).collect()}
    assert got == {"drone_battery_percent": 50.0, "drone_altitude_meters": 2.0}


def test_exact_quantiles(spark):
    rng = random.Random(9)
    rows = [(rng.choice("hhhhab"), rng.choice([rng.gauss(0, 50), 7.0, 0.0, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    for keys, groups in [(["k"], "hab"), ([], ["*"])]:
        got = {getattr(r, "k", "*") if keys else "*": r for r in fleet.exact_quantiles(df, "v", keys, [0.05, 0.5, 0.99]).collect()}
        for g in groups:
            values = [v for k, v in rows if v is not None and g in (k, "*")]
            want = np.quantile(values, [0.05, 0.5, 0.99])
            assert [got[g].p5, got[g].p50, got[g].p99] == pytest.approx(want, rel=1e-12, abs=1e-12)
