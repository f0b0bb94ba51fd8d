"""Telemetry-shaped tables derived from the generic test tables.

Each is a projection of a whole table: no sampling, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drone_name(number: Column) -> Column:
    """``drone-`` and the number, zero-padded to at least four digits."""
    digits = number.cast("string")
    return F.concat(F.lit("drone-"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on a compressed clock: one hour becomes one second. ``us`` is microseconds."""
    since = F.expr(
        f"(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'{EPOCH} 00:00:00')) div 3600"
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("us", since)
        .withColumn("t", F.col("us") / F.lit(1e6))
        .withColumn("drone_id", drone_name(F.col("user_id")))
        .withColumn("swarm_id", F.concat(F.lit("swarm-"), (F.col("user_id") % 4).cast("string")))
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed_events(spark, sf_dir)
    eid, uid, t = F.col("event_id"), F.col("user_id"), F.col("t")
    battery = F.greatest(
        F.lit(0.0),
        F.lit(100.0) - t * (F.lit(0.08) + (uid % 5) * F.lit(0.02)) - (eid % 7) * F.lit(0.5),
    )
    fourth = F.when(eid % 58 == 0, 4000.0).when(eid % 29 == 0, 5000.0).otherwise(8510.0)
    rpm = (
        F.when(eid % 103 == 0, F.array(F.lit(8500.0), F.lit(8500.0), F.lit(8500.0)))
        .when(eid % 101 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        .otherwise(F.array(
            F.lit(8500.0),
            F.lit(8500.0) + (eid % 5) * F.lit(20.0),
            F.lit(8500.0) - (eid % 3) * F.lit(15.0),
            fourth,
        ))
    )
    heat = F.when(F.col("event_type") == "error", F.lit(20.0) + (eid % 20) * F.lit(2.0)).otherwise(F.lit(0.0))
    return (
        e.withColumns({
            "battery_percent": battery,
            "altitude_m": F.col("value") * F.lit(0.5),
            "velocity_ms": (eid % 40).cast("double"),
        })
        .select(
            "event_id", "drone_id", "swarm_id", "us",
            t.alias("timestamp_s"),
            F.expr(f"timestamp_micros(unix_micros(timestamp'{EPOCH} 00:00:00') + us)").alias("ts"),
            "battery_percent",
            (F.lit(18.0) + F.lit(4.5) * F.col("battery_percent") / F.lit(100.0) - (eid % 4) * F.lit(0.1))
            .alias("battery_voltage"),
            "altitude_m", "velocity_ms",
            (F.lit(37.7749) + (eid % 11) * F.lit(0.00002) + F.when(eid % 97 == 0, 0.05).otherwise(0.0))
            .alias("latitude"),
            (F.lit(-122.4194) + (eid % 13) * F.lit(0.00002)).alias("longitude"),
            rpm.alias("motor_rpm"),
            (F.lit(25.0) + F.col("velocity_ms") * F.lit(0.5) + heat).alias("temperature_c"),
            (F.lit(-40.0) - F.col("altitude_m") * F.lit(0.3)).alias("signal_dbm"),
            (eid % 17 != 0).alias("connected"),
        )
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight boxes per frame, one frame every 0.1 s, frames of 200 x 160."""
    eid = F.col("event_id")
    frame = F.expr("event_id div 8")
    x1, y1 = (eid * 37) % 120, (eid * 53) % 80
    return table(spark, sf_dir, "events").select(
        eid.alias("det_id"),
        frame.alias("frame_no"),
        (eid % 8).alias("det_idx"),
        drone_name(frame % 10).alias("drone_id"),
        (eid % 10).alias("cls_id"),
        (((eid * 61) % 1000) / F.lit(1000.0)).alias("conf"),
        x1.alias("x1"), y1.alias("y1"),
        (x1 + 40 + (eid * 11) % 30).alias("x2"),
        (y1 + 40 + (eid * 7) % 30).alias("y2"),
        (frame * 100_000).alias("us"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame, with the timing of its inference."""
    number = F.col("frame_no")
    modes = F.array(*[F.lit(m) for m in ("ULTRA_FAST", "FAST", "BALANCED", "ACCURATE")])
    return (
        detections(spark, sf_dir).groupBy("frame_no", "drone_id").agg(F.min("us").alias("us"))
        .select(
            "frame_no", "drone_id", "us",
            F.lit("yolov26s").alias("model_name"),
            F.get(modes, (number % 4).cast("int")).alias("speed_mode"),
            (F.lit(0.01) + (number % 60) * F.lit(0.01)).alias("latency_s"),
        )
        .withColumn("fps", F.lit(1.0) / F.col("latency_s"))
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mission commands: the purchase events."""
    names = F.array(*[F.lit(c) for c in ("land", "return_home", "hover", "patrol")])
    return timed_events(spark, sf_dir).filter("event_type = 'purchase'").select(
        "event_id", "drone_id", "us", F.get(names, (F.col("event_id") % 4).cast("int")).alias("command")
    )


def command_side_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry the commands are matched against: all other events."""
    return timed_events(spark, sf_dir).filter("event_type <> 'purchase'").select("event_id", "drone_id", "us")
