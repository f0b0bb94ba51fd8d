"""Bring simulator and local-frame records into telemetry form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Offsets per local metre, ambient heat and signal loss.
LAT_PER_M, LON_PER_M = 0.000009, 0.000011
AMBIENT_C, HEAT_PER_MS = 25.0, 0.5
SIGNAL_AT_GROUND, SIGNAL_PER_M = -40.0, 0.3


def speed(vx: str, vy: str, vz: str) -> Column:
    x, y, z = F.col(vx), F.col(vy), F.col(vz)
    return F.sqrt(x * x + y * y + z * z)


def from_local_frame(df: DataFrame) -> DataFrame:
    """Telemetry from an entity in a local metric frame.

    Takes ``entity_id, x, y, z, vx, vy, vz, battery_level, battery_voltage_current, motor_speeds``.
    """
    height = F.greatest(F.col("z"), F.lit(0.0))
    return df.withColumn("velocity_ms", speed("vx", "vy", "vz")).withColumns({
        "drone_id": F.format_string("drone-%03d", "entity_id"),
        "battery_percent": F.col("battery_level"),
        "battery_voltage": F.col("battery_voltage_current"),
        "altitude_m": height,
        "latitude": F.col("x") * LAT_PER_M,
        "longitude": F.col("y") * LON_PER_M,
        "motor_rpm": F.col("motor_speeds"),
        "temperature_c": F.lit(AMBIENT_C) + F.col("velocity_ms") * HEAT_PER_MS,
        "signal_dbm": F.lit(SIGNAL_AT_GROUND) - height * SIGNAL_PER_M,
        "connected": F.col("battery_level") > 0,
    })


def map_axes(df: DataFrame) -> DataFrame:
    """Flip z from down to up, and read a collision as a lost connection."""
    return df.withColumn("z", -F.col("z")).withColumn("connected", ~F.col("collided"))
