"""Boundaries of the score and anomaly expressions."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import health
from fleetlens.operators import anomalies

TELEMETRY = ("event_id bigint, drone_id string, swarm_id string, us bigint, battery_percent double, battery_voltage double, "
             "velocity_ms double, latitude double, longitude double, motor_rpm array<double>, temperature_c double, signal_dbm double")


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_battery(spark):
    rows = [(0.0, 17.0), (0.0, 18.0), (100.0, 19.0), (100.0, 22.2), (120.0, 24.0)]
    got = values(spark, rows, "p double, v double", F.round(health.battery_health("p", "v"), 4))
    assert got == [0.0, 0.0, 0.6952, 1.0, 1.12]


def test_motors(spark):
    rows = [(None,), ([1.0, 2.0, 3.0],), ([0.0] * 4,), ([100.0] * 4,), ([70.0, 130.0, 70.0, 130.0],), ([50.0, 150.0, 50.0, 150.0],)]
    got = values(spark, rows, "r array<double>", F.round(health.motor_health("r"), 4))
    assert got == [0.5, 0.5, 1.0, 1.0, 0.0, 0.0]


def test_signal_and_heat(spark):
    assert values(spark, [(-110.0,), (-100.0,), (-65.0,), (-30.0,), (0.0,)], "d double", health.signal_health("d")) == [0, 0, 0.5, 1, 1]
    heat = values(spark, [(50.0,), (65.0,), (70.0,), (80.0,), (81.0,)], "t double", F.round(health.thermal_health("t"), 4))
    assert heat == [1.0, 0.5, 0.3333, 0.0, 0.0]


def test_weights_are_a_parameter(spark):
    documented = {"battery": 0.40, "motor": 0.25, "signal": 0.20, "thermal": 0.15}
    got = values(spark, [(1.0, 0.0, 0.0, 1.0)], "b double, m double, s double, t double",
                 F.round(health.overall_score("b", "m", "s", "t", documented), 4))
    assert got == [0.55]


def test_fleet_member_score_has_no_signal_floor(spark):
    got = values(spark, [(None, None, None), (100.0, -130.0, 110.0)], "p double, d double, t double",
                 F.round(health.fleet_member_score("p", "d", "t"), 4))
    assert got == [0.3, 0.25]


def record(i, us, battery=90.0, velocity=5.0, lat=0.0, rpm=(100.0,) * 4, heat=20.0, drone="d"):
    return (i, drone, "s", us, battery, 22.2, velocity, lat, 0.0, None if rpm is None else list(rpm), heat, -50.0)


def telemetry(spark, rows):
    return spark.createDataFrame(rows, TELEMETRY).withColumn("timestamp_s", F.col("us") / 1e6)


def flags(spark, rows, **options):
    scored = anomalies.score(telemetry(spark, rows), **options)
    return {r.event_id: (r.anomaly_flags, r) for r in scored.collect()}


def test_first_record_has_no_deltas(spark):
    assert flags(spark, [record(1, 0, lat=50.0)])[1][0] == []


def test_drain_limits(spark):
    # 0.1 and 0.2 per second, in numbers that are exact in binary at the chosen step
    rows = [record(1, 0, 90.0), record(2, 10_000_000, 89.0), record(3, 20_000_000, 87.0), record(4, 30_000_000, 84.0)]
    got = flags(spark, rows)
    assert got[2][0] == [] and got[3][0] == ["rapid_battery_drain"]
    severities = {r.event_id: r.severity for r in anomalies.alerts(
        anomalies.score(telemetry(spark, rows))).collect()}
    assert severities == {3: "critical", 4: "critical"}


def test_equal_time_skips_drain(spark):
    assert flags(spark, [record(1, 0, 90.0), record(2, 0, 10.0)])[2][0] == []


def test_previous_record_expires(spark):
    rows = [record(1, 0, 90.0), record(2, 599_999_999, 10.0), record(3, 1_199_999_999, 0.0)]
    got = flags(spark, rows)
    assert got[2][0] == ["rapid_battery_drain"]
    assert got[3][1].prev is None and got[3][0] == []


@pytest.mark.parametrize("velocity, drifting", [(29.0, True), (30.0, False)])
def test_gps_needs_low_velocity(spark, velocity, drifting):
    rows = [record(1, 0), record(2, 1_000_000, velocity=velocity, lat=0.01)]
    assert (flags(spark, rows)[2][0] == ["gps_drift"]) is drifting


def test_gps_step_has_a_floor(spark):
    # 9.99 m in 10 ms: 999 m/s by the clock, 99.9 m/s over the smallest step of 0.1 s
    rows = [record(1, 0), record(2, 10_000, lat=0.00009)]
    assert flags(spark, rows)[2][0] == []


def test_flag_order(spark):
    rows = [record(1, 0), record(2, 1_000_000, battery=50.0, lat=0.01, rpm=(1.0, 100.0, 1.0, 100.0), heat=90.0)]
    assert flags(spark, rows)[2][0] == ["rapid_battery_drain", "motor_imbalance", "gps_drift", "overheating"]


def test_spoofed_fix(spark):
    rows = [record(1, 0), record(2, 1_000_000, lat=0.001), record(3, 2_000_000, lat=0.001)]
    kept = anomalies.accepted_fixes(telemetry(spark, rows))
    assert sorted(r.event_id for r in kept.collect()) == [1, 3]
