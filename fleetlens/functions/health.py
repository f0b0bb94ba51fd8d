"""Health scores as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlens.functions.columns import ColumnLike, clamp, col

# Weights of the four components, and of the short fleet formula.
WEIGHTS = {"battery": 0.35, "motor": 0.25, "signal": 0.20, "thermal": 0.20}
FLEET_WEIGHTS = {"battery": 0.4, "signal": 0.3, "thermal": 0.3}


def battery_health(percent: ColumnLike, voltage: ColumnLike) -> Column:
    """Charge level (not clamped) plus a penalty for voltage sag below 22.2 V."""
    sag = clamp((col(voltage) - F.lit(18.0)) / F.lit(22.2 - 18.0), 0.0, 1.0)
    return F.lit(0.6) * (col(percent) / F.lit(100.0)) + F.lit(0.4) * sag


def motor_mean(rpm: ColumnLike) -> Column:
    """Mean speed of the four motors; null unless there are exactly four."""
    r = [F.get(col(rpm), F.lit(i)) for i in range(4)]
    return F.when(F.size(col(rpm)) == 4, (r[0] + r[1] + r[2] + r[3]) / F.lit(4.0))


def motor_cv(rpm: ColumnLike, mean: ColumnLike | None = None) -> Column:
    """Coefficient of variation (population form); null when unknown or all motors are off.

    Pass a ready ``mean`` column where there is one: it occurs ten times in the expression.
    """
    mean = motor_mean(rpm) if mean is None else col(mean)
    squares = [(F.get(col(rpm), F.lit(i)) - mean) * (F.get(col(rpm), F.lit(i)) - mean) for i in range(4)]
    deviation = F.sqrt((squares[0] + squares[1] + squares[2] + squares[3]) / F.lit(4.0))
    return F.when(mean != 0, deviation / mean)


def motor_health(rpm: ColumnLike, mean: ColumnLike | None = None, cv: ColumnLike | None = None) -> Column:
    """1 for even speeds, falling to 0 at a variation of 0.3; 0.5 when unknown, 1 when off."""
    mean = motor_mean(rpm) if mean is None else col(mean)
    variation = motor_cv(rpm, mean) if cv is None else col(cv)
    return (
        F.when(mean.isNull(), F.lit(0.5))
        .when(mean == 0, F.lit(1.0))
        .otherwise(F.greatest(F.lit(1.0) - variation / F.lit(0.3), F.lit(0.0)))
    )


def signal_health(dbm: ColumnLike) -> Column:
    return clamp((col(dbm) + F.lit(100.0)) / F.lit(70.0), 0.0, 1.0)


def thermal_health(celsius: ColumnLike) -> Column:
    t = col(celsius)
    return (
        F.when(t <= 50, F.lit(1.0))
        .when(t <= 80, F.lit(1.0) - (t - F.lit(50.0)) / F.lit(30.0))
        .otherwise(F.lit(0.0))
    )


def overall_score(
    battery: ColumnLike, motor: ColumnLike, signal: ColumnLike, thermal: ColumnLike,
    weights: dict[str, float] = WEIGHTS,
) -> Column:
    return (
        F.lit(weights["battery"]) * col(battery)
        + F.lit(weights["motor"]) * col(motor)
        + F.lit(weights["signal"]) * col(signal)
        + F.lit(weights["thermal"]) * col(thermal)
    )


def fleet_member_score(percent: ColumnLike, dbm: ColumnLike, celsius: ColumnLike) -> Column:
    """The short formula behind swarm health. The signal term has no lower bound."""
    percent = F.coalesce(col(percent), F.lit(0.0))
    dbm = F.coalesce(col(dbm), F.lit(-100.0))
    celsius = F.coalesce(col(celsius), F.lit(25.0))
    battery = F.least(percent / F.lit(100.0), F.lit(1.0))
    signal = F.least((dbm + F.lit(100.0)) / F.lit(60.0), F.lit(1.0))
    thermal = F.lit(1.0) - F.greatest((celsius - F.lit(60.0)) / F.lit(40.0), F.lit(0.0))
    return (
        F.lit(FLEET_WEIGHTS["battery"]) * battery
        + F.lit(FLEET_WEIGHTS["signal"]) * signal
        + F.lit(FLEET_WEIGHTS["thermal"]) * F.greatest(thermal, F.lit(0.0))
    )
