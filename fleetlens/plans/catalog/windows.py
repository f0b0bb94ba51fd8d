"""Windows, sessions, rolling values."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import fixtures
from fleetlens.operators import anomalies, windows
from fleetlens.plans.catalog.base import ALERTS, DETECTIONS, SCORED, TELEMETRY, query
from fleetlens.plans.catalog.health import scored


def epoch_us(name):
    """A window bound as microseconds since the fixture's first day."""
    return F.unix_micros(name) - F.expr("unix_micros(timestamp'2024-01-01 00:00:00')")


@query("event_time", f"WITH {TELEMETRY} SELECT event_id, us // 1000 AS event_ms FROM tele")
def event_time(spark, sf_dir):
    return fixtures.telemetry(spark, sf_dir).select("event_id", F.expr("us div 1000").alias("event_ms"))


def _avg(name, alias):
    return f"R4(sum({name}::DECIMAL(18,4))::DOUBLE / count(*)) AS {alias}"


@query("tumbling_health", f"""WITH {SCORED}
SELECT drone_id, us // 10000000 * 10000000 AS start_us, count(*) AS n, {_avg("overall_score", "avg_score")},
  min(overall_score) AS min_score, max(overall_score) AS max_score, {_avg("battery_health", "avg_battery_health")},
  {_avg("motor_health", "avg_motor_health")}, {_avg("signal_health", "avg_signal_health")},
  {_avg("thermal_health", "avg_thermal_health")},
  sum(coalesce(is_drain, false)::INT + coalesce(is_motor, false)::INT + coalesce(is_gps, false)::INT + is_heat::INT)::BIGINT AS n_anomalies
FROM scored GROUP BY drone_id, us // 10000000""")
def tumbling_health(spark, sf_dir):
    w = windows.tumbling(scored(spark, sf_dir))
    rounded = [c for c in w.columns if c.startswith("avg_")]
    return w.select("drone_id", epoch_us("window_start").alias("start_us"), "n", "min_score", "max_score",
                    "n_anomalies", *[F.round(c, 4).alias(c) for c in rounded])


SLIDES = """,
slid AS (
  SELECT *, unnest(range(us // 10000000 * 10000000 - {size} + 10000000, us // 10000000 * 10000000 + 1, 10000000)) AS start_us
  FROM tele),
trend AS (
  SELECT drone_id, start_us, count(*) AS n, sum(temperature_c::DECIMAL(18,8))::DOUBLE / count(*) AS avg_temperature, sum(battery_percent::DECIMAL(18,8))::DOUBLE / count(*) AS avg_battery,
    CASE WHEN count(*) > 1 THEN regr_slope(temperature_c, (us - start_us) / 1e6) END AS temperature_slope,
    CASE WHEN count(*) > 1 THEN regr_slope(battery_percent, (us - start_us) / 1e6) END AS battery_slope,
    arg_max(battery_percent, us) AS last_battery
  FROM slid GROUP BY drone_id, start_us)"""


def _trend(name, size_s):
    @query(name, f"""WITH {TELEMETRY}{SLIDES.format(size=size_s * 1_000_000)}
SELECT drone_id, start_us, n, R4(avg_temperature) AS avg_temperature, R4(avg_battery) AS avg_battery,
  R4(temperature_slope) AS temperature_slope, R4(battery_slope) AS battery_slope FROM trend""")
    def run(spark, sf_dir):
        t = windows.sliding(fixtures.telemetry(spark, sf_dir), size_s=size_s)
        names = ["avg_temperature", "avg_battery", "temperature_slope", "battery_slope"]
        return t.select("drone_id", "start_us", "n", *[F.round(c, 4).alias(c) for c in names])


_trend("sliding_trend", 60)
_trend("sliding_trend_5min", 300)


@query("battery_prediction", f"""WITH {TELEMETRY}{SLIDES.format(size=60_000_000)}
SELECT drone_id, start_us, R4(last_battery) AS last_battery,
  R2(CASE WHEN -battery_slope > 0 THEN last_battery / -battery_slope END) AS seconds_to_empty FROM trend""")
def battery_prediction(spark, sf_dir):
    p = windows.battery_prediction(windows.sliding(fixtures.telemetry(spark, sf_dir)))
    return p.select("drone_id", "start_us", F.round("last_battery", 4).alias("last_battery"),
                    F.round("seconds_to_empty", 2).alias("seconds_to_empty"))


def _sessions(name, gap_s):
    gap = gap_s * 1_000_000

    @query(name, f"""WITH {SCORED},
opened AS (SELECT *, CASE WHEN p_us IS NOT NULL AND us - p_us <= {gap} THEN 0 ELSE 1 END AS opens FROM scored),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY drone_id ORDER BY us, event_id) AS session FROM opened)
SELECT drone_id, session::BIGINT AS session, min(us) AS start_us, max(us) AS end_us, count(*) AS n,
  R4((max(us) - min(us)) / 1e6) AS duration_s, max(altitude_m) AS max_altitude,
  R4(arg_min(battery_percent, us) - arg_max(battery_percent, us)) AS battery_used,
  R2(sum(CASE WHEN opens = 0 THEN hop_m ELSE 0e0 END)) AS distance_m
FROM numbered GROUP BY drone_id, session""")
    def run(spark, sf_dir):
        s = windows.sessions(fixtures.telemetry(spark, sf_dir), gap_s=gap_s)
        return s.select("drone_id", "session", "start_us", "end_us", "n", "max_altitude",
                        F.round("duration_s", 4).alias("duration_s"), F.round("battery_used", 4).alias("battery_used"),
                        F.round("distance_m", 2).alias("distance_m"))


_sessions("mission_segments", 30)
_sessions("mission_segments_5min", 300)


@query("rolling_frame_rate", f"""WITH {TELEMETRY},
placed AS (
  SELECT event_id, drone_id, us, row_number() OVER w - 1 AS before, first_value(us) OVER (w ROWS 30 PRECEDING) AS since
  FROM tele WINDOW w AS (PARTITION BY drone_id ORDER BY us, event_id))
SELECT event_id, drone_id,
  R4(CASE WHEN before > 0 THEN least(before, 30)::DOUBLE / ((us - since) / 1e6) ELSE 0e0 END) AS fps
FROM placed""")
def rolling_frame_rate(spark, sf_dir):
    r = windows.rolling_rate(fixtures.telemetry(spark, sf_dir).select("event_id", "drone_id", "us"))
    return r.select("event_id", "drone_id", F.round("fps", 4).alias("fps"))


@query("recent_events", f"""WITH {ALERTS}
SELECT event_id, alert_type, '[' || strftime(make_timestamp(us), '%H:%M:%S') || '] ' || message AS line
FROM alert ORDER BY us DESC, event_id DESC, alert_type DESC LIMIT 20""")
def recent_events(spark, sf_dir):
    a = anomalies.alerts(scored(spark, sf_dir))
    return windows.recent_events(a, "message", "event_id", "alert_type").select("event_id", "alert_type", "line")


@query("recent_targets", f"""WITH {DETECTIONS}
SELECT drone_id, det_id, recency FROM (
  SELECT drone_id, det_id, row_number() OVER (PARTITION BY drone_id ORDER BY frame_no DESC, det_idx DESC) AS recency FROM det)
WHERE recency <= 30""")
def recent_targets(spark, sf_dir):
    d = windows.recent_per_key(fixtures.detections(spark, sf_dir), ["drone_id"], "frame_no", "det_idx")
    return d.select("drone_id", "det_id", F.col("recency").cast("bigint").alias("recency"))
