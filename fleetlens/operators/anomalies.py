"""Scores, anomaly flags and alerts of telemetry records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import health
from fleetlens.functions.columns import seconds
from fleetlens.operators.ordered import DEFAULT_SLICE_US, with_previous

# Limits of the four anomaly kinds.
DRAIN_LIMIT, DRAIN_CRITICAL = 0.1, 0.2
CV_LIMIT, CV_CRITICAL = 0.15, 0.25
GPS_SPEED_LIMIT, GPS_MAX_VELOCITY, GPS_THRESHOLD = 100.0, 30.0, 500.0
HEAT_LIMIT, HEAT_CRITICAL = 70.0, 80.0
METERS_PER_DEGREE = 111_000.0
MIN_STEP_S = 0.1
STATE_TTL_S = 600

PREVIOUS_FIELDS = ["us", "battery_percent", "latitude", "longitude"]


def hop_m(lat: Column, lon: Column, prev_lat: Column, prev_lon: Column) -> Column:
    """Flat distance in metres; longitude is not corrected for latitude."""
    dlat = F.abs(lat - prev_lat) * F.lit(METERS_PER_DEGREE)
    dlon = F.abs(lon - prev_lon) * F.lit(METERS_PER_DEGREE)
    return F.sqrt(dlat * dlat + dlon * dlon)


def with_deltas(
    df: DataFrame, ttl_s: int = STATE_TTL_S, width_us: int = DEFAULT_SLICE_US, tie: str = "event_id"
) -> DataFrame:
    """Add the previous record and what follows from it: ``drain_rate``, ``hop_m``, ``implied_speed``.

    A previous record that is ``ttl_s`` or more older counts as absent.
    """
    rows = with_previous(df, ["drone_id"], "us", tie, PREVIOUS_FIELDS, "prev", width_us)
    return add_delta_columns(rows, ttl_s)


def add_delta_columns(rows: DataFrame, ttl_s: int = STATE_TTL_S) -> DataFrame:
    """The delta columns, for rows that already carry ``prev``; shared by batch and stream."""
    alive = F.col("us") - F.col("prev.us") < F.lit(ttl_s * 1_000_000)
    rows = rows.withColumn("prev", F.when(alive, F.col("prev")))
    dt = seconds(F.col("us") - F.col("prev.us"))
    return rows.withColumns({
        "drain_rate": F.when(
            F.col("prev.us") < F.col("us"), (F.col("prev.battery_percent") - F.col("battery_percent")) / dt
        ),
        "hop_m": hop_m(F.col("latitude"), F.col("longitude"), F.col("prev.latitude"), F.col("prev.longitude")),
        "step_s": dt,
    }).withColumn("implied_speed", F.col("hop_m") / F.greatest(F.col("step_s"), F.lit(MIN_STEP_S)))


def _conditions() -> dict[str, Column]:
    return {
        "rapid_battery_drain": F.col("drain_rate") > DRAIN_LIMIT,
        "motor_imbalance": F.col("rpm_cv") > CV_LIMIT,
        "gps_drift": (F.col("implied_speed") > GPS_SPEED_LIMIT) & (F.col("velocity_ms") < GPS_MAX_VELOCITY),
        "overheating": F.col("temperature_c") > HEAT_LIMIT,
    }


def add_scores(rows: DataFrame, weights: dict[str, float] = health.WEIGHTS) -> DataFrame:
    """Add component scores, ``overall_score`` and ``anomaly_flags`` to rows with delta columns."""
    rows = rows.withColumn("rpm_mean", health.motor_mean("motor_rpm"))
    rows = rows.withColumn("rpm_cv", health.motor_cv("motor_rpm", "rpm_mean"))
    parts = rows.withColumns({
        "_battery": health.battery_health("battery_percent", "battery_voltage"),
        "_motor": health.motor_health("motor_rpm", "rpm_mean", "rpm_cv"),
        "_signal": health.signal_health("signal_dbm"),
        "_thermal": health.thermal_health("temperature_c"),
    })
    overall = health.overall_score("_battery", "_motor", "_signal", "_thermal", weights)
    return parts.withColumns({
        "overall_score": F.round(overall, 4),
        "battery_health": F.round("_battery", 4),
        "motor_health": F.round("_motor", 4),
        "signal_health": F.round("_signal", 4),
        "thermal_health": F.round("_thermal", 4),
        "anomaly_flags": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _conditions().items()])),
    }).drop("_battery", "_motor", "_signal", "_thermal", "rpm_mean")


def score(
    df: DataFrame, weights: dict[str, float] = health.WEIGHTS, ttl_s: int = STATE_TTL_S,
    width_us: int = DEFAULT_SLICE_US,
) -> DataFrame:
    """Score every telemetry record and flag its anomalies."""
    return add_scores(with_deltas(df, ttl_s, width_us), weights)


# The messages, which readers of the alerts topic match.
def alerts(scored: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """One row per anomaly of a scored record, zero to four per record; ``also`` names further columns to keep."""
    when = _conditions()

    def alert(kind: str, severity: Column, message: Column, value: Column, threshold: float) -> Column:
        return F.when(when[kind], F.struct(
            F.lit(kind).alias("alert_type"),
            severity.alias("severity"),
            message.alias("message"),
            value.alias("metric_value"),
            F.lit(threshold).alias("threshold"),
        ))

    def graded(metric: str, critical_from: float) -> Column:
        return F.when(F.col(metric) < critical_from, "warning").otherwise("critical")

    rpms = F.concat(F.lit("["), F.array_join(F.col("motor_rpm").cast("array<string>"), ", "), F.lit("]"))
    kinds = F.array_compact(F.array(
        alert(
            "rapid_battery_drain", graded("drain_rate", DRAIN_CRITICAL),
            F.format_string("Battery draining at %.3f%%/s (normal: <0.05%%/s)", "drain_rate"),
            F.round("drain_rate", 4), DRAIN_LIMIT,
        ),
        alert(
            "motor_imbalance", graded("rpm_cv", CV_CRITICAL),
            F.format_string("Motor RPM coefficient of variation: %.3f (threshold: 0.15). RPMs: %s", "rpm_cv", rpms),
            F.round("rpm_cv", 4), CV_LIMIT,
        ),
        alert(
            "gps_drift", F.lit("warning"),
            F.format_string(
                "GPS jump of %.1fm implies %.1fm/s but reported velocity is %.1fm/s",
                "hop_m", "implied_speed", "velocity_ms",
            ),
            F.round("hop_m", 2), GPS_THRESHOLD,
        ),
        alert(
            "overheating", F.when(F.col("temperature_c") > HEAT_CRITICAL, "critical").otherwise("warning"),
            F.format_string("Temperature %s°C exceeds safe limit (70°C)", F.col("temperature_c").cast("string")),
            F.col("temperature_c"), HEAT_LIMIT,
        ),
    ))
    return (
        scored.filter(F.size("anomaly_flags") > 0)
        .select("drone_id", "swarm_id", "event_id", "us", "timestamp_s", *also, F.explode(kinds).alias("alert"))
        .select("drone_id", "swarm_id", "event_id", "us", "timestamp_s", *also, "alert.*")
    )


def flagged(scored: DataFrame) -> DataFrame:
    """Scores with at least one anomaly."""
    return scored.filter(F.size("anomaly_flags") > 0)


def spoof_check(df: DataFrame, max_speed_ms: float = 30.0, width_us: int = DEFAULT_SLICE_US) -> DataFrame:
    """Flag fixes that would need more than ``max_speed_ms`` from the fix before."""
    moved = with_deltas(df, width_us=width_us)
    return moved.withColumn("spoofed", F.coalesce(F.col("implied_speed") > max_speed_ms, F.lit(False)))


def accepted_fixes(df: DataFrame, max_speed_ms: float = 30.0, width_us: int = DEFAULT_SLICE_US) -> DataFrame:
    return spoof_check(df, max_speed_ms, width_us).filter(~F.col("spoofed"))


def fleet_health_report(scored: DataFrame) -> DataFrame:
    """Per drone: records, anomalies by kind and severity, and the lowest score."""
    when = _conditions()

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    drain, motor, heat = when["rapid_battery_drain"], when["motor_imbalance"], when["overheating"]
    return scored.groupBy("drone_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        n(drain & (F.col("drain_rate") < DRAIN_CRITICAL)).alias("drain_warning"),
        n(drain & (F.col("drain_rate") >= DRAIN_CRITICAL)).alias("drain_critical"),
        n(motor & (F.col("rpm_cv") < CV_CRITICAL)).alias("motor_warning"),
        n(motor & (F.col("rpm_cv") >= CV_CRITICAL)).alias("motor_critical"),
        n(when["gps_drift"]).alias("gps_warning"),
        n(heat & (F.col("temperature_c") <= HEAT_CRITICAL)).alias("heat_warning"),
        n(heat & (F.col("temperature_c") > HEAT_CRITICAL)).alias("heat_critical"),
        F.min("overall_score").alias("min_score"),
    )
