"""Topics: encoding, decoding, provenance, rejects, partitions; and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import fixtures
from fleetlens.operators import anomalies, commands, fleet, logs
from fleetlens.operators.cooldown import cooldown
from fleetlens.plans.catalog.base import ALERTS, COOLED, DETECTIONS, EVENTS, SCORED, TELEMETRY, query
from fleetlens.plans.catalog.fleet import CLASSES, COMMANDS, FRAMES
from fleetlens.plans.catalog.health import scored
from fleetlens.schemas import READER_DEFAULTS
from fleetlens.session import shared_dir
from fleetlens.sources import decode, topics

USER_OF_KEY = "cast(substring(key, 7) as bigint)"


def telemetry_log(spark, sf_dir):
    encoded = topics.encode_telemetry(fixtures.telemetry(spark, sf_dir))
    return topics.as_log(encoded, "telemetry", partition=F.expr(f"{USER_OF_KEY} % 6"))


LOG = EVENTS + """,
log AS (
  SELECT event_id, drone_id, us, t, user_id % 6 AS partition,
    row_number() OVER (PARTITION BY user_id % 6 ORDER BY us, event_id) - 1 AS "offset" FROM ev)"""


@query("topic_records", f"""WITH {LOG}
SELECT 'drone.telemetry' AS topic, partition::INT AS partition, "offset", drone_id AS key, us FROM log""")
def topic_records(spark, sf_dir):
    return telemetry_log(spark, sf_dir).select("topic", "partition", "offset", "key", F.unix_micros("timestamp").alias("us"))


@query("topic_provenance", f"""WITH {LOG}
SELECT drone_id, 'drone.telemetry' AS topic, partition::INT AS partition, "offset", us // 1000 AS record_ms, us FROM log""")
def topic_provenance(spark, sf_dir):
    good, _ = decode.decode_telemetry(topics.with_provenance(telemetry_log(spark, sf_dir)))
    return good.select("drone_id", "_meta.topic", "_meta.partition", "_meta.offset",
                       F.col("_meta.timestamp").alias("record_ms"), "us")


@query("decoded_telemetry", f"""WITH {TELEMETRY}
SELECT drone_id, swarm_id, us, R4(battery_percent) AS battery_percent, R4(battery_voltage) AS battery_voltage, altitude_m,
  velocity_ms, R6(latitude) AS latitude, R6(longitude) AS longitude, array_to_string(motor_rpm, ',') AS motor_rpm,
  temperature_c, R4(signal_dbm) AS signal_dbm, connected FROM tele""")
def decoded_telemetry(spark, sf_dir):
    good, _ = decode.decode_telemetry(topics.encode(fixtures.telemetry(spark, sf_dir), "telemetry").select("value"))
    rounded = {"battery_percent": 4, "battery_voltage": 4, "latitude": 6, "longitude": 6, "signal_dbm": 4}
    return good.select(
        "drone_id", "swarm_id", "us", "altitude_m", "velocity_ms", "temperature_c", "connected",
        F.array_join(F.col("motor_rpm").cast("array<string>"), ",").alias("motor_rpm"),
        *[F.round(c, n).alias(c) for c, n in rounded.items()],
    )


def damaged_log(spark, sf_dir):
    """The telemetry topic with five kinds of unusual records mixed in; the last lacks time and fields."""
    kind = F.col("event_id") % 8
    encoded = topics.encode_telemetry(fixtures.telemetry(spark, sf_dir))
    value = (
        F.when(kind == 0, '{"drone_id": "broken')
        .when(kind == 1, '[{"drone_id": "drone-0001"}]')
        .when(kind == 2, '{"drone_id": "drone-0001", "battery_percent": "high"}')
        .when(kind == 3, '{"swarm_id": "swarm-1"}')
        .when(kind == 4, F.concat(
            F.lit('{"drone_id": "'), F.col("key"),
            F.lit('", "battery_percent": null, "position": null, "motor_rpm": null, "extra": 5}')))
        .otherwise(F.col("value"))
    )
    return encoded.withColumns({"value": value, "timestamp": F.timestamp_micros("us")})


@query("quarantined_records", f"WITH {EVENTS} SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'json_decode' ELSE 'processing' END AS error_type FROM ev WHERE event_id % 8 < 4")
def quarantined_records(spark, sf_dir):
    _, bad = decode.decode_telemetry(damaged_log(spark, sf_dir))
    return bad.select("event_id", "error_type")


@query("error_counts", f"WITH {EVENTS} SELECT CASE event_id % 8 WHEN 0 THEN 'json_decode' ELSE 'processing' END AS error_type, count(*) AS n FROM ev WHERE event_id % 8 < 4 GROUP BY 1")
def error_counts(spark, sf_dir):
    return decode.error_counts(decode.parse(damaged_log(spark, sf_dir), "telemetry"))


@query("reader_defaults", f"""WITH {TELEMETRY}
SELECT event_id, drone_id, CASE WHEN event_id % 8 = 4 THEN 'default' ELSE swarm_id END AS swarm_id,
  CASE WHEN event_id % 8 = 4 THEN 0e0 ELSE R4(battery_percent) END AS battery_percent,
  CASE WHEN event_id % 8 = 4 THEN 0e0 ELSE R6(latitude) END AS latitude,
  CASE WHEN event_id % 8 = 4 THEN '0.0,0.0,0.0,0.0' ELSE array_to_string(motor_rpm, ',') END AS motor_rpm,
  CASE WHEN event_id % 8 = 4 THEN -100e0 ELSE R4(signal_dbm) END AS signal_dbm,
  CASE WHEN event_id % 8 = 4 THEN false ELSE connected END AS connected,
  us
FROM tele WHERE event_id % 8 >= 4""")
def reader_defaults(spark, sf_dir):
    good, _ = decode.decode_telemetry(damaged_log(spark, sf_dir).drop("us"))
    return good.select(
        "event_id", "drone_id", "swarm_id", F.round("battery_percent", 4).alias("battery_percent"),
        F.round("latitude", 6).alias("latitude"), F.array_join(F.col("motor_rpm").cast("array<string>"), ",").alias("motor_rpm"),
        F.round("signal_dbm", 4).alias("signal_dbm"), "connected", "us",
    )


# Telemetry as a reader has it of the damaged topic: unreadable records gone, absent fields filled in,
# an absent time replaced by the record's, which has milliseconds.
_ABSENT = {c: f"{v!r}".lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v:e}" for c, v in READER_DEFAULTS.items()}
DAMAGED = TELEMETRY.replace("tele AS (\n  SELECT event_id", "full_tele AS (\n  SELECT event_id") + """,
tele AS (SELECT * REPLACE (""" + ", ".join(
    f"CASE WHEN event_id % 8 = 4 THEN {v} ELSE {c} END AS {c}" for c, v in _ABSENT.items()) + """,
  CASE WHEN event_id % 8 = 4 THEN [0e0, 0e0, 0e0, 0e0] ELSE motor_rpm END AS motor_rpm,
  CASE WHEN event_id % 8 = 4 THEN us // 1000 * 1000 ELSE us END AS us) FROM full_tele WHERE event_id % 8 >= 4)"""
DAMAGED_SCORED = SCORED.replace(TELEMETRY, DAMAGED)


def damaged_topic(spark, sf_dir):
    """The damaged records as a folder topic, written in two appends; a record's offset is its event."""
    folder = shared_dir(spark, "damaged-topic")
    records = topics.as_records(damaged_log(spark, sf_dir), "telemetry")
    for half in (0, 1):
        topics.write_topic(records.filter(F.col("offset") % 2 == half), "telemetry", folder)
    return folder


def numbered(rows):
    return rows.withColumn("event_id", F.col("_meta.offset"))


@query("topic_scores_without_time", f"""WITH {DAMAGED_SCORED}
SELECT event_id, drone_id, us, overall_score, battery_health, motor_health, signal_health, thermal_health, flags FROM scored""")
def topic_scores_without_time(spark, sf_dir):
    rows = numbered(topics.read_topic(spark, "telemetry", damaged_topic(spark, sf_dir)))
    return anomalies.score(rows).select(
        "event_id", "drone_id", "us", "overall_score", "battery_health", "motor_health", "signal_health", "thermal_health",
        F.array_join("anomaly_flags", ",").alias("flags"))


ABSENT_GAUGES = ["drone_battery_percent", "drone_altitude_meters", "drone_signal_strength_dbm", "drone_latitude"]
GAUGES_WITH_ABSENT = f"""WITH {TELEMETRY},
heard AS (
  SELECT event_id, drone_id, CASE WHEN event_id % 8 = 4 THEN us // 1000 * 1000 ELSE us END AS us,
    CASE WHEN event_id % 8 = 4 THEN 'default' ELSE swarm_id END AS swarm_id, CASE WHEN event_id % 8 <> 4 THEN battery_percent END AS b, CASE WHEN event_id % 8 <> 4 THEN altitude_m END AS a,
    CASE WHEN event_id % 8 <> 4 THEN signal_dbm END AS s, CASE WHEN event_id % 8 <> 4 THEN latitude END AS l
  FROM tele WHERE event_id % 8 >= 4)
SELECT drone_id, swarm_id, R4(arg_max(b, (us, event_id))) AS drone_battery_percent, R4(arg_max(a, (us, event_id))) AS drone_altitude_meters,
  R4(arg_max(s, (us, event_id))) AS drone_signal_strength_dbm, R6(arg_max(l, (us, event_id))) AS drone_latitude
FROM heard GROUP BY drone_id, swarm_id"""


def rounded_gauges(rows):
    return rows.select("drone_id", "swarm_id", *[
        F.round(g, 6 if g == "drone_latitude" else 4).alias(g) for g in ABSENT_GAUGES])


@query("gauges_with_absent_fields", GAUGES_WITH_ABSENT)
def gauges_with_absent_fields(spark, sf_dir):
    return rounded_gauges(fleet.gauges_wide(numbered(topics.read_topic(spark, "telemetry", damaged_topic(spark, sf_dir), raw=True))))


@query("topic_rejects", f"""WITH {EVENTS}
SELECT event_id, 'drone.telemetry' AS topic, CASE event_id % 8 WHEN 0 THEN 'json_decode' ELSE 'processing' END AS error_type FROM ev WHERE event_id % 8 < 4""")
def topic_rejects(spark, sf_dir):
    bad = topics.read_rejects(spark, "telemetry", damaged_topic(spark, sf_dir))
    return bad.select(F.col("_meta.offset").alias("event_id"), "_meta.topic", "error_type")


@query("alerts_topic", f"""WITH RECURSIVE {COOLED}
SELECT drone_id, swarm_id, timestamp_s AS timestamp, alert_type, severity, message, metric_value, threshold FROM cooled""")
def alerts_topic(spark, sf_dir):
    """Cooled alerts through their topic."""
    cooled = cooldown(anomalies.alerts(scored(spark, sf_dir)))
    folder = shared_dir(spark, "alerts-topic")
    topics.write_topic(topics.as_records(topics.encode(cooled, "alerts"), "alerts"), "alerts", folder)
    return topics.read_topic(spark, "alerts", folder).select(
        "drone_id", "swarm_id", "timestamp", "alert_type", "severity", "message", "metric_value", "threshold")


@query("first_messages", f"""WITH {LOG}
SELECT drone_id, partition::INT AS partition, "offset" FROM log WHERE event_id % 8 >= 4 ORDER BY partition, "offset" LIMIT 50""")
def first_messages(spark, sf_dir):
    damaged = topics.as_log(damaged_log(spark, sf_dir).drop("timestamp"), "telemetry", partition=F.expr(f"{USER_OF_KEY} % 6"))
    first = topics.first_decoded(topics.with_provenance(damaged), "telemetry", 50)
    return first.select("drone_id", "_meta.partition", "_meta.offset")


@query("keyed_json", f"""WITH {TELEMETRY}
SELECT event_id, drone_id AS key, drone_id AS json_drone, timestamp_s AS json_timestamp, altitude_m AS json_altitude,
  R6(latitude) AS json_lat, connected AS json_connected, len(motor_rpm)::BIGINT AS json_motors FROM tele""")
def keyed_json(spark, sf_dir):
    e = topics.encode(fixtures.telemetry(spark, sf_dir), "telemetry")

    def at(path, kind):
        return F.get_json_object("value", path).cast(kind)

    return e.select(
        "event_id", "key", at("$.drone_id", "string").alias("json_drone"), at("$.timestamp", "double").alias("json_timestamp"),
        at("$.altitude_m", "double").alias("json_altitude"), F.round(at("$.position.lat", "double"), 6).alias("json_lat"),
        at("$.connected", "boolean").alias("json_connected"),
        F.json_array_length(F.get_json_object("value", "$.motor_rpm")).cast("bigint").alias("json_motors"),
    )


@query("writer_defaults", f"""WITH {TELEMETRY}
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 100e0 ELSE R4(battery_percent) END AS battery_percent,
  222e-1 AS battery_voltage, CASE WHEN event_id % 5 = 0 THEN 25e0 ELSE temperature_c END AS temperature_c,
  -50e0 AS signal_dbm, CASE WHEN event_id % 4 = 0 THEN true ELSE connected END AS connected,
  CASE WHEN event_id % 2 = 0 THEN 'default' ELSE swarm_id END AS swarm_id FROM tele""")
def writer_defaults(spark, sf_dir):
    def blank(n, c):
        return F.when(F.col("event_id") % n != 0, F.col(c))

    partial = fixtures.telemetry(spark, sf_dir).drop("battery_voltage", "signal_dbm").withColumns({
        "battery_percent": blank(3, "battery_percent"), "temperature_c": blank(5, "temperature_c"),
        "connected": blank(4, "connected"), "swarm_id": blank(2, "swarm_id"),
    })
    good, _ = decode.decode_telemetry(topics.encode(partial, "telemetry").drop("us"))
    return good.select("event_id", F.round("battery_percent", 4).alias("battery_percent"), "battery_voltage",
                       "temperature_c", "signal_dbm", "connected", "swarm_id")


def inference_records(spark, sf_dir):
    """The detections of every frame as one record of the inference topic."""
    from fleetlens.operators import lookups

    named = lookups.with_class_name(fixtures.detections(spark, sf_dir), lookups.class_table(spark))
    boxes = topics.gather_detections(named.withColumn("track_id", F.col("det_id")), ["drone_id", "frame_no"])
    timed = fixtures.frames(spark, sf_dir).join(boxes, ["drone_id", "frame_no"], "left")
    return topics.encode(timed.withColumn("timestamp_s", F.col("us") / F.lit(1e6)), "inference")


@query("decoded_inference", f"""WITH {FRAMES}
SELECT f.drone_id, f.us, model_name, speed_mode, R4(latency_s) AS latency_s, R4(fps) AS fps, count(*) AS n_detections,
  R3(max(conf)) AS best_confidence
FROM frame f JOIN det d USING (frame_no) GROUP BY f.drone_id, f.us, model_name, speed_mode, latency_s, fps""")
def decoded_inference(spark, sf_dir):
    good, _ = decode.decode_inference(inference_records(spark, sf_dir).select("value"))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return good.select("drone_id", "us", "model_name", "speed_mode", F.round("latency_s", 4).alias("latency_s"),
                       F.round("fps", 4).alias("fps"), F.size("detections").cast("bigint").alias("n_detections"),
                       F.round(best, 3).alias("best_confidence"))


@query("detection_table", f"""WITH {DETECTIONS}
SELECT drone_id, us, det_idx, det_id AS track_id, class_name, R3(conf) AS conf, x1::DOUBLE AS x1, y1::DOUBLE AS y1,
  x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM det JOIN {CLASSES} USING (cls_id)""")
def detection_table(spark, sf_dir):
    good, _ = decode.decode_inference(inference_records(spark, sf_dir).select("value"))
    return decode.detection_table(good).select("drone_id", "us", "det_idx", "track_id", "class_name",
                                               F.round("conf", 3).alias("conf"), "x1", "y1", "x2", "y2")


@query("detection_counts", f"WITH {DETECTIONS} SELECT drone_id, class_name, count(*) AS n FROM det JOIN {CLASSES} USING (cls_id) GROUP BY drone_id, class_name")
def detection_counts(spark, sf_dir):
    good, _ = decode.decode_inference(inference_records(spark, sf_dir).select("value"))
    return fleet.detection_counts(good)


def command_records(spark, sf_dir):
    c = fixtures.commands(spark, sf_dir).withColumn("timestamp_s", F.col("us") / F.lit(1e6))
    parameters = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("speed"), (F.col("event_id") % 10).cast("string")))
    return topics.encode(c.withColumn("parameters", parameters), "commands")


@query("decoded_commands", f"""WITH {COMMANDS}
SELECT event_id, drone_id, us / 1e6 AS timestamp, command, 'langgraph' AS issued_by,
  CASE WHEN event_id % 2 = 0 THEN (event_id % 10)::VARCHAR END AS speed FROM cmd""")
def decoded_commands(spark, sf_dir):
    good, _ = decode.decode(command_records(spark, sf_dir).drop("us"), "commands")
    return good.select("event_id", "drone_id", "timestamp", "command", "issued_by", F.col("parameters")["speed"].alias("speed"))


@query("decoded_battery_events", f"""WITH {TELEMETRY}
SELECT event_id, drone_id, timestamp_s AS timestamp, CASE WHEN battery_percent < 10 THEN 'critical_battery' ELSE 'low_battery' END AS event_type,
  R4(battery_percent) AS battery_percent FROM tele WHERE battery_percent < 20""")
def decoded_battery_events(spark, sf_dir):
    events = topics.encode(commands.battery_events(fixtures.telemetry(spark, sf_dir)), "battery_events")
    good, _ = decode.decode(events.drop("us"), "battery_events")
    return good.select("event_id", "drone_id", "timestamp", "event_type", F.round("battery_percent", 4).alias("battery_percent"))


@query("decoded_alerts", f"WITH {ALERTS} SELECT event_id, drone_id, alert_type, severity, message, metric_value, threshold, timestamp_s AS timestamp FROM alert")
def decoded_alerts(spark, sf_dir):
    encoded = topics.encode(anomalies.alerts(scored(spark, sf_dir)), "alerts")
    good, _ = decode.decode(encoded.drop("us"), "alerts")
    return good.select("event_id", "drone_id", "alert_type", "severity", "message", "metric_value", "threshold", "timestamp")


@query("decoded_scores", f"WITH {SCORED} SELECT event_id, drone_id, overall_score, battery_health, motor_health, signal_health, thermal_health, flags FROM scored")
def decoded_scores(spark, sf_dir):
    good, _ = decode.decode(topics.encode(scored(spark, sf_dir), "metrics").drop("us"), "metrics")
    return good.select("event_id", "drone_id", "overall_score", "battery_health", "motor_health", "signal_health",
                       "thermal_health", F.array_join("anomaly_flags", ",").alias("flags"))


@query("message_counts", f"""WITH {COMMANDS}
SELECT 'drone.telemetry' AS topic, count(*) AS messages FROM ev
UNION ALL SELECT 'drone.mission.commands', count(*) FROM cmd
UNION ALL SELECT 'drone.inference.results', count(DISTINCT event_id // 8) FROM ev""")
def message_counts(spark, sf_dir):
    parts = {
        "drone.telemetry": topics.encode(fixtures.telemetry(spark, sf_dir), "telemetry"),
        "drone.mission.commands": command_records(spark, sf_dir),
        "drone.inference.results": inference_records(spark, sf_dir),
    }
    records = None
    for name, encoded in parts.items():
        part = encoded.select(F.lit(name).alias("topic"), "key")
        records = part if records is None else records.union(part)
    return fleet.message_counts(records)


@query("keyed_partitions", f"WITH {TELEMETRY} SELECT drone_id, 1::BIGINT AS tasks, true AS in_range, count(*) AS n FROM tele GROUP BY drone_id")
def keyed_partitions(spark, sf_dir):
    placed = topics.partition_by_key(fixtures.telemetry(spark, sf_dir).select("drone_id"), "telemetry")
    numbered = placed.withColumn("task", F.spark_partition_id()).withColumn("p", topics.partition_of("drone_id", 6))
    return numbered.groupBy("drone_id").agg(
        F.count_distinct("task").alias("tasks"), F.every(F.col("p").between(0, 5)).alias("in_range"), F.count(F.lit(1)).alias("n")
    )


def log_lines(spark, sf_dir):
    e = fixtures.timed_events(spark, sf_dir)
    is_fleet = F.col("event_type") == "error"
    message = F.when(is_fleet, F.to_json(F.struct(
        "drone_id", F.when(F.col("event_id") % 2 == 0, "critical").otherwise("warning").alias("severity"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    ))).otherwise(F.col("props"))
    pod = F.concat(F.lit("/var/log/containers/bridge-"), F.col("user_id").cast("string"),
                   F.lit("_fleet-prod_"), F.col("event_type"), F.lit("-0a1b2c3d.log"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(is_fleet, "fleet").otherwise("other").alias("app"),
                    message.alias("message"), pod.alias("file_path"))


@query("pod_metadata", "SELECT event_id, 'bridge-' || user_id AS pod, 'fleet-prod' AS namespace, event_type AS container FROM events")
def pod_metadata(spark, sf_dir):
    return logs.pod_metadata(log_lines(spark, sf_dir)).select("event_id", "pod", "namespace", "container")


@query("conditional_json_logs", f"""WITH {EVENTS}
SELECT event_id, CASE WHEN event_type = 'error' THEN drone_id END AS drone_id,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE 'warning' END END AS severity,
  CASE WHEN event_type = 'error' THEN (props->>'$.k')::BIGINT END AS k FROM ev""")
def conditional_json_logs(spark, sf_dir):
    return logs.parse_json_logs(log_lines(spark, sf_dir)).select("event_id", "fields.drone_id", "fields.severity", "fields.k")


@query("daily_log_index", "SELECT 'fleet-logs-' || strftime(ts, '%Y.%m.%d') AS index_name, count(*) AS n FROM events GROUP BY 1")
def daily_log_index(spark, sf_dir):
    return logs.daily_index(log_lines(spark, sf_dir)).groupBy("index_name").agg(F.count(F.lit(1)).alias("n"))


@query("log_search", f"WITH {EVENTS} SELECT event_id, drone_id FROM ev WHERE event_type = 'error' AND event_id % 2 = 0 AND drone_id = 'drone-0007'")
def log_search(spark, sf_dir):
    parsed = logs.parse_json_logs(log_lines(spark, sf_dir))
    return logs.search(parsed, "drone-0007", "critical").select("event_id", "fields.drone_id")
