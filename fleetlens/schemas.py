"""Record schemas, topic registry and default values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING, DOUBLE, LONG, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TELEMETRY = _struct(
    drone_id=STRING,
    swarm_id=STRING,
    timestamp=DOUBLE,
    battery_percent=DOUBLE,
    battery_voltage=DOUBLE,
    altitude_m=DOUBLE,
    velocity_ms=DOUBLE,
    position=_struct(lat=DOUBLE, lon=DOUBLE),
    motor_rpm=T.ArrayType(DOUBLE),
    temperature_c=DOUBLE,
    signal_dbm=DOUBLE,
    connected=BOOL,
)

DETECTION = T.StructType([
    T.StructField("track_id", LONG),
    T.StructField("class", STRING),
    T.StructField("confidence", DOUBLE),
    T.StructField("bbox", T.ArrayType(DOUBLE)),
])

INFERENCE = _struct(
    drone_id=STRING,
    timestamp=DOUBLE,
    model_name=STRING,
    model=STRING,
    speed_mode=STRING,
    latency_s=DOUBLE,
    fps=DOUBLE,
    detections=T.ArrayType(DETECTION),
)

HEALTH_SCORE = _struct(
    drone_id=STRING,
    swarm_id=STRING,
    timestamp=DOUBLE,
    overall_score=DOUBLE,
    battery_health=DOUBLE,
    motor_health=DOUBLE,
    signal_health=DOUBLE,
    thermal_health=DOUBLE,
    anomaly_flags=T.ArrayType(STRING),
)

HEALTH_ALERT = _struct(
    drone_id=STRING,
    swarm_id=STRING,
    timestamp=DOUBLE,
    alert_type=STRING,
    severity=STRING,
    message=STRING,
    metric_value=DOUBLE,
    threshold=DOUBLE,
)

MISSION_COMMAND = _struct(
    drone_id=STRING,
    timestamp=DOUBLE,
    command=STRING,
    parameters=T.MapType(STRING, STRING),
    issued_by=STRING,
)

BATTERY_EVENT = _struct(
    drone_id=STRING,
    timestamp=DOUBLE,
    event_type=STRING,
    battery_percent=DOUBLE,
    details=STRING,
)


@dataclass(frozen=True)
class Topic:
    name: str
    schema: T.StructType
    partitions: int
    retention_s: int | None


# Topic names, partition counts and retention.
TOPICS = {
    "telemetry": Topic("drone.telemetry", TELEMETRY, 6, 86_400),
    "inference": Topic("drone.inference.results", INFERENCE, 6, 86_400),
    "alerts": Topic("drone.health.alerts", HEALTH_ALERT, 3, 604_800),
    "commands": Topic("drone.mission.commands", MISSION_COMMAND, 3, 604_800),
    "battery_events": Topic("drone.battery.events", BATTERY_EVENT, 3, None),
    "metrics": Topic("drone.metrics.aggregated", HEALTH_SCORE, 3, None),
    # Our own: scores with anomalies, apart from the alert records.
    "flagged": Topic("drone.health.flagged", HEALTH_SCORE, 3, 604_800),
}

# Retention of stored metric samples: 30 days.
METRIC_RETENTION_S = 30 * 86_400

# What a reader assumes for an absent telemetry field.
READER_DEFAULTS = {
    "swarm_id": "default",
    "battery_percent": 0.0,
    "battery_voltage": 0.0,
    "altitude_m": 0.0,
    "velocity_ms": 0.0,
    "latitude": 0.0,
    "longitude": 0.0,
    "temperature_c": 0.0,
    "signal_dbm": -100.0,
    "connected": False,
}

# What a writer fills in. They differ from the reader's on purpose.
WRITER_DEFAULTS = {
    "swarm_id": "default",
    "battery_percent": 100.0,
    "battery_voltage": 22.2,
    "altitude_m": 0.0,
    "velocity_ms": 0.0,
    "latitude": 0.0,
    "longitude": 0.0,
    "temperature_c": 25.0,
    "signal_dbm": -50.0,
    "connected": True,
}

INFERENCE_WRITER_DEFAULTS = {"model_name": "yolov26s", "speed_mode": "FAST", "latency_s": 0.0, "fps": 0.0}

# Class names by class id.
CLASS_NAMES = [
    "pedestrian", "people", "bicycle", "car", "van",
    "truck", "tricycle", "awning-tricycle", "bus", "motor",
]

# Speed modes (mode, image size, tile rows, tile columns, overlap, target rate).
SPEED_MODES = [
    ("ULTRA_FAST", 640, 1, 1, 0.0, 30),
    ("FAST", 1280, 1, 1, 0.0, 20),
    ("BALANCED", 640, 2, 2, 0.1, 10),
    ("ACCURATE", 640, 3, 3, 0.2, 5),
]
