"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def expand_rounding(sql: str) -> str:
    """Write ``R4(x)`` out as a rounding to four digits that agrees with Spark's.

    Spark rounds the shortest decimal form of a double half up; DuckDB scales and rounds the
    binary value. The two differ on ties, so the SQL goes through the decimal form as well.
    """
    while (found := re.search(r"\bR(\d)\(", sql)) is not None:
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[found.end():end - 1]
        rounded = f"round(({inner})::VARCHAR::DECIMAL(38,20), {found.group(1)})::DOUBLE"
        sql = sql[:found.start()] + rounded + sql[end:]
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its DuckDB equivalent, where there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand_rounding(sql)
        return fn

    return register


# Common table expressions of the derived tables, in DuckDB's dialect. Decimal literals are
# cast, because DuckDB would otherwise compute them in fixed point.
EVENTS = """
ev AS (
  SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600 AS us,
         ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600) / 1e6 AS t,
         'drone-' || lpad(user_id::VARCHAR, 4, '0') AS drone_id,
         'swarm-' || (user_id % 4)::VARCHAR AS swarm_id
  FROM events)"""

TELEMETRY = EVENTS + """,
raw_tele AS (
  SELECT *,
    greatest(0e0, 100e0 - t * (8e-2 + (user_id % 5) * 2e-2) - (event_id % 7) * 5e-1) AS battery_percent,
    value * 5e-1 AS altitude_m,
    (event_id % 40)::DOUBLE AS velocity_ms
  FROM ev),
tele AS (
  SELECT event_id, drone_id, swarm_id, us, t AS timestamp_s, battery_percent,
    18e0 + 45e-1 * battery_percent / 100e0 - (event_id % 4) * 1e-1 AS battery_voltage,
    altitude_m, velocity_ms,
    377749e-4 + (event_id % 11) * 2e-5 + CASE WHEN event_id % 97 = 0 THEN 5e-2 ELSE 0e0 END AS latitude,
    -1224194e-4 + (event_id % 13) * 2e-5 AS longitude,
    CASE WHEN event_id % 103 = 0 THEN [8500e0, 8500e0, 8500e0]
         WHEN event_id % 101 = 0 THEN [0e0, 0e0, 0e0, 0e0]
         ELSE [8500e0, 8500e0 + (event_id % 5) * 20e0, 8500e0 - (event_id % 3) * 15e0,
               CASE WHEN event_id % 58 = 0 THEN 4000e0 WHEN event_id % 29 = 0 THEN 5000e0 ELSE 8510e0 END]
    END AS motor_rpm,
    25e0 + velocity_ms * 5e-1 + CASE WHEN event_type = 'error' THEN 20e0 + (event_id % 20) * 2e0 ELSE 0e0 END AS temperature_c,
    -40e0 - altitude_m * 3e-1 AS signal_dbm,
    event_id % 17 <> 0 AS connected
  FROM raw_tele)"""

DETECTIONS = """
det AS (
  SELECT event_id AS det_id, event_id // 8 AS frame_no, event_id % 8 AS det_idx,
    'drone-' || lpad(((event_id // 8) % 10)::VARCHAR, 4, '0') AS drone_id,
    event_id % 10 AS cls_id, ((event_id * 61) % 1000) / 1000e0 AS conf,
    (event_id * 37) % 120 AS x1, (event_id * 53) % 80 AS y1,
    (event_id * 37) % 120 + 40 + (event_id * 11) % 30 AS x2,
    (event_id * 53) % 80 + 40 + (event_id * 7) % 30 AS y2,
    (event_id // 8) * 100000 AS us
  FROM events)"""

# Previous record per drone, deltas, scores and alerts, as plain window functions.
SCORED = TELEMETRY + """,
lagged AS (
  SELECT *, lag(us) OVER w AS p_us, lag(battery_percent) OVER w AS p_batt,
         lag(latitude) OVER w AS p_lat, lag(longitude) OVER w AS p_lon
  FROM tele WINDOW w AS (PARTITION BY drone_id ORDER BY us, event_id)),
alive AS (
  SELECT * EXCLUDE (p_us, p_batt, p_lat, p_lon),
    CASE WHEN us - p_us < 600000000 THEN p_us END AS p_us,
    CASE WHEN us - p_us < 600000000 THEN p_batt END AS p_batt,
    CASE WHEN us - p_us < 600000000 THEN p_lat END AS p_lat,
    CASE WHEN us - p_us < 600000000 THEN p_lon END AS p_lon
  FROM lagged),
delta AS (
  SELECT *, (us - p_us) / 1e6 AS step_s,
    CASE WHEN p_us < us THEN (p_batt - battery_percent) / ((us - p_us) / 1e6) END AS drain_rate,
    sqrt((abs(latitude - p_lat) * 111000e0) * (abs(latitude - p_lat) * 111000e0)
       + (abs(longitude - p_lon) * 111000e0) * (abs(longitude - p_lon) * 111000e0)) AS hop_m
  FROM alive),
motion AS (
  SELECT *, hop_m / greatest(step_s, 1e-1) AS implied_speed,
    CASE WHEN len(motor_rpm) = 4 THEN (motor_rpm[1] + motor_rpm[2] + motor_rpm[3] + motor_rpm[4]) / 4e0 END AS rpm_mean
  FROM delta),
varied AS (
  SELECT *, CASE WHEN rpm_mean <> 0 THEN sqrt((
      (motor_rpm[1] - rpm_mean) * (motor_rpm[1] - rpm_mean) + (motor_rpm[2] - rpm_mean) * (motor_rpm[2] - rpm_mean)
    + (motor_rpm[3] - rpm_mean) * (motor_rpm[3] - rpm_mean) + (motor_rpm[4] - rpm_mean) * (motor_rpm[4] - rpm_mean)) / 4e0)
    / rpm_mean END AS rpm_cv
  FROM motion),
parts AS (
  SELECT *,
    6e-1 * (battery_percent / 100e0) + 4e-1 * greatest(least((battery_voltage - 18e0) / (222e-1 - 18e0), 1e0), 0e0) AS b,
    CASE WHEN rpm_mean IS NULL THEN 5e-1 WHEN rpm_mean = 0 THEN 1e0 ELSE greatest(1e0 - rpm_cv / 3e-1, 0e0) END AS m,
    greatest(least((signal_dbm + 100e0) / 70e0, 1e0), 0e0) AS s,
    CASE WHEN temperature_c <= 50 THEN 1e0 WHEN temperature_c <= 80 THEN 1e0 - (temperature_c - 50e0) / 30e0 ELSE 0e0 END AS h,
    drain_rate > 1e-1 AS is_drain, rpm_cv > 15e-2 AS is_motor,
    implied_speed > 100 AND velocity_ms < 30 AS is_gps, temperature_c > 70 AS is_heat
  FROM varied),
scored AS (
  SELECT *, R4(35e-2 * b + 25e-2 * m + 2e-1 * s + 2e-1 * h) AS overall_score,
    R4(b) AS battery_health, R4(m) AS motor_health, R4(s) AS signal_health, R4(h) AS thermal_health,
    concat_ws(',', CASE WHEN is_drain THEN 'rapid_battery_drain' END, CASE WHEN is_motor THEN 'motor_imbalance' END,
                   CASE WHEN is_gps THEN 'gps_drift' END, CASE WHEN is_heat THEN 'overheating' END) AS flags
  FROM parts)"""

ALERTS = SCORED + """,
alert AS (
  SELECT drone_id, swarm_id, event_id, us, timestamp_s, 'rapid_battery_drain' AS alert_type,
    CASE WHEN drain_rate < 2e-1 THEN 'warning' ELSE 'critical' END AS severity,
    printf('Battery draining at %.3f%%/s (normal: <0.05%%/s)', drain_rate) AS message,
    R4(drain_rate) AS metric_value, 1e-1 AS threshold FROM scored WHERE is_drain
  UNION ALL
  SELECT drone_id, swarm_id, event_id, us, timestamp_s, 'motor_imbalance',
    CASE WHEN rpm_cv < 25e-2 THEN 'warning' ELSE 'critical' END,
    printf('Motor RPM coefficient of variation: %.3f (threshold: 0.15). RPMs: %s', rpm_cv, motor_rpm::VARCHAR),
    R4(rpm_cv), 15e-2 FROM scored WHERE is_motor
  UNION ALL
  SELECT drone_id, swarm_id, event_id, us, timestamp_s, 'gps_drift', 'warning',
    printf('GPS jump of %.1fm implies %.1fm/s but reported velocity is %.1fm/s', hop_m, implied_speed, velocity_ms),
    R2(hop_m), 500e0 FROM scored WHERE is_gps
  UNION ALL
  SELECT drone_id, swarm_id, event_id, us, timestamp_s, 'overheating',
    CASE WHEN temperature_c > 80 THEN 'critical' ELSE 'warning' END,
    printf('Temperature %s°C exceeds safe limit (70°C)', temperature_c::VARCHAR),
    temperature_c, 70e0 FROM scored WHERE is_heat)"""

# Greedy cooldown: the next emission depends on the last one, so the SQL form is recursive.
COOLED = ALERTS + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY drone_id, alert_type ORDER BY us, event_id) AS rn,
    CASE WHEN severity = 'critical' THEN 10000000 ELSE 30000000 END AS period
  FROM alert),
walk(drone_id, alert_type, rn, event_id, last_us, emitted) AS (
  SELECT drone_id, alert_type, rn, event_id,
    CASE WHEN us > period THEN us ELSE 0 END, us > period
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.drone_id, r.alert_type, r.rn, r.event_id,
    CASE WHEN r.us - w.last_us > r.period THEN r.us ELSE w.last_us END, r.us - w.last_us > r.period
  FROM walk w JOIN ranked r ON r.drone_id = w.drone_id AND r.alert_type = w.alert_type AND r.rn = w.rn + 1),
cooled AS (
  SELECT a.* FROM alert a JOIN walk w USING (drone_id, alert_type, event_id) WHERE w.emitted)"""
