"""Streaming jobs driven to completion over file topics; results must equal the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import fixtures
from fleetlens.operators import fleet, lookups
from fleetlens.plans import rules
from fleetlens.plans.catalog.base import COOLED, EVENTS, SCORED, TELEMETRY, query
from fleetlens.plans.catalog.detections import follow_sql, tracks
from fleetlens.plans.catalog.fleet import _ASOF, _MODES, FRAMES
from fleetlens.plans.catalog.health import ALERT_COLUMNS
from fleetlens.plans.catalog.rules import CONNECTED, SAMPLES, grid_sql, state_sql
from fleetlens.plans.catalog.topics import DAMAGED_SCORED, GAUGES_WITH_ABSENT, damaged_log, numbered, rounded_gauges
from fleetlens.plans.catalog.windows import _avg
from fleetlens.session import shared_dir
from fleetlens.sources import topics
from fleetlens.streaming import alerting, following, jobs, joins, snapshots

SLICE_US = 240_000_000
SLICES = 3
WATERMARK_US = 5_000_000


def telemetry_slices(spark, sf_dir):
    """Telemetry in consecutive slices of time, as it would arrive; together they are all of it."""
    t = fixtures.telemetry(spark, sf_dir)
    for i in range(SLICES):
        lower = F.col("us") >= i * SLICE_US if i else F.lit(True)
        upper = F.col("us") < (i + 1) * SLICE_US if i + 1 < SLICES else F.lit(True)
        yield t.filter(lower & upper)


def arriving(spark, folder):
    """The stream of decoded records of a file topic, with a record id as tie-break."""
    records = topics.read_topic_stream(spark, "telemetry", folder)
    return records.withColumn("event_id", F.col("_meta.offset")).drop("_meta")


def run_health(spark, sf_dir):
    """Feed the health job slice by slice, restarting it from its checkpoint each time."""
    folder, target, checkpoint = (shared_dir(spark, n) for n in ("telemetry", "health", "health-state"))
    for part in telemetry_slices(spark, sf_dir):
        topics.write_topic(topics.as_records(topics.encode_telemetry(part), "telemetry"), "telemetry", folder)
        jobs.run_health_job(arriving(spark, folder), target, checkpoint, availableNow=True).awaitTermination()
    return target


@query("streamed_health_scores", f"""WITH {SCORED}
SELECT event_id, drone_id, overall_score, battery_health, motor_health, signal_health, thermal_health, flags FROM scored""")
def streamed_health_scores(spark, sf_dir):
    scores = spark.read.parquet(f"{run_health(spark, sf_dir)}/scores")
    return scores.select("event_id", "drone_id", "overall_score", "battery_health", "motor_health", "signal_health",
                         "thermal_health", F.array_join("anomaly_flags", ",").alias("flags"))


@query("streamed_alerts", f"WITH RECURSIVE {COOLED} SELECT {', '.join(ALERT_COLUMNS)} FROM cooled")
def streamed_alerts(spark, sf_dir):
    return spark.read.parquet(f"{run_health(spark, sf_dir)}/alerts").select(ALERT_COLUMNS)


def damaged_slices(spark, sf_dir):
    records = topics.as_records(damaged_log(spark, sf_dir), "telemetry")
    at = F.unix_micros("timestamp")
    for i in range(SLICES):
        upper = at < (i + 1) * SLICE_US if i + 1 < SLICES else F.lit(True)
        yield records.filter((at >= i * SLICE_US) & upper)


@query("streamed_topic_scores_without_time", f"""WITH {DAMAGED_SCORED}
SELECT event_id, drone_id, us, overall_score, battery_health, flags FROM scored""")
def streamed_topic_scores_without_time(spark, sf_dir):
    folder, target, checkpoint = (shared_dir(spark, n) for n in ("damaged", "health", "health-state"))
    for part in damaged_slices(spark, sf_dir):
        topics.write_topic(part, "telemetry", folder)
        jobs.run_health_job(arriving(spark, folder), target, checkpoint, availableNow=True).awaitTermination()
    return spark.read.parquet(f"{target}/scores").select(
        "event_id", "drone_id", "us", "overall_score", "battery_health", F.array_join("anomaly_flags", ",").alias("flags"))


@query("streamed_gauges_with_absent_fields", GAUGES_WITH_ABSENT)
def streamed_gauges_with_absent_fields(spark, sf_dir):
    folder, target, checkpoint = (shared_dir(spark, n) for n in ("damaged", "gauges", "gauges-state"))
    for part in damaged_slices(spark, sf_dir):
        topics.write_topic(part, "telemetry", folder)
        heard = numbered(topics.read_topic_stream(spark, "telemetry", folder, raw=True))
        jobs.run_gauges_job(heard, target, checkpoint, availableNow=True).awaitTermination()
    return rounded_gauges(jobs.current_gauges(spark, target))


@query("streamed_rejects", f"""WITH {EVENTS}
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'json_decode' ELSE 'processing' END AS error_type FROM ev WHERE event_id % 8 < 4""")
def streamed_rejects(spark, sf_dir):
    folder, target, checkpoint = (shared_dir(spark, n) for n in ("damaged", "rejects", "rejects-state"))
    for part in damaged_slices(spark, sf_dir):
        topics.write_topic(part, "telemetry", folder)
        bad = topics.read_rejects_stream(spark, "telemetry", folder)
        jobs.run_append(bad, target, checkpoint, availableNow=True).awaitTermination()
    return spark.read.parquet(target).select(F.col("_meta.offset").alias("event_id"), "error_type")


@query("streamed_alerts_topic", f"""WITH RECURSIVE {COOLED}
SELECT drone_id, swarm_id, timestamp_s AS timestamp, alert_type, severity, message, metric_value, threshold FROM cooled""")
def streamed_alerts_topic(spark, sf_dir):
    """Cooled alerts that the health job sends to their topic, read back as that topic."""
    folder, target, checkpoint = (shared_dir(spark, n) for n in ("telemetry", "topics", "health-state"))
    for part in telemetry_slices(spark, sf_dir):
        topics.write_topic(topics.as_records(topics.encode_telemetry(part), "telemetry"), "telemetry", folder)
        jobs.run_health_to_topics(arriving(spark, folder), target, checkpoint, availableNow=True).awaitTermination()
    return topics.read_topic(spark, "alerts", target).select(
        "drone_id", "swarm_id", "timestamp", "alert_type", "severity", "message", "metric_value", "threshold")


@query("streamed_swarm_health", f"""WITH {TELEMETRY},
last AS (
  SELECT drone_id, arg_max(swarm_id, (us, event_id)) AS swarm_id, max(us) AS seen, arg_max(battery_percent, (us, event_id)) AS b,
    arg_max(signal_dbm, (us, event_id)) AS s, arg_max(temperature_c, (us, event_id)) AS h FROM tele GROUP BY drone_id)
SELECT swarm_id, count(*) FILTER ((SELECT max(us) FROM tele) - seen < 30000000) AS active_drones FROM last GROUP BY swarm_id""")
def streamed_swarm_health(spark, sf_dir):
    folder, target, checkpoint = (shared_dir(spark, n) for n in ("swarm-in", "swarms", "swarm-state"))
    for part in telemetry_slices(spark, sf_dir):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        jobs.run_swarm_job(stream, target, checkpoint, availableNow=True).awaitTermination()
    newest = jobs.current(spark, target, ["swarm_id"])
    return newest.select("swarm_id", "active_drones")


def run_scored_windows(spark, sf_dir, make, name):
    """Windows over the health job's scores: a second job reads what the first one writes, where it lies.

    The scores are there whole when it starts; a late sentinel then closes the last window.
    """
    written = run_health(spark, sf_dir)
    scores = spark.read.parquet(f"{written}/scores").drop("batch_id")
    target, checkpoint = (shared_dir(spark, f"{name}-{n}") for n in ("out", "state"))

    def run():
        # Batches of the health job, and the sentinel beside them.
        stream = spark.readStream.schema(scores.schema).parquet(f"{written}/{{scores/batch_id=*,closing}}")
        jobs.run_append(make(stream), target, checkpoint, availableNow=True).awaitTermination()

    run()
    newest = scores.agg(F.max("us").alias("m")).scalar()
    closing = scores.limit(1).withColumns({"us": newest + 3_600_000_000, "drone_id": F.lit("sentinel")})
    closing.withColumn("ts", F.timestamp_micros("us")).select(scores.columns).write.parquet(f"{written}/closing")
    run()
    return spark.read.parquet(target).filter("drone_id <> 'sentinel'")


@query("streamed_tumbling_health", f"""WITH {SCORED}
SELECT drone_id, us // 10000000 * 10000000 AS start_us, count(*) AS n, {_avg("overall_score", "avg_score")},
  min(overall_score) AS min_score, max(overall_score) AS max_score, {_avg("battery_health", "avg_battery_health")},
  {_avg("motor_health", "avg_motor_health")}, {_avg("signal_health", "avg_signal_health")},
  {_avg("thermal_health", "avg_thermal_health")},
  sum(coalesce(is_drain, false)::INT + coalesce(is_motor, false)::INT + coalesce(is_gps, false)::INT + is_heat::INT)::BIGINT AS n_anomalies
FROM scored GROUP BY drone_id, us // 10000000""")
def streamed_tumbling_health(spark, sf_dir):
    w = run_scored_windows(spark, sf_dir, jobs.tumbling_stream, "tumbling")
    rounded = [c for c in w.columns if c.startswith("avg_")]
    return w.select("drone_id", F.unix_micros("window_start").alias("start_us"), "n", "min_score", "max_score", "n_anomalies",
                    *[F.round(c, 4).alias(c) for c in rounded])


@query("streamed_sessions", f"""WITH {SCORED},
opened AS (SELECT *, CASE WHEN p_us IS NOT NULL AND us - p_us <= 30000000 THEN 0 ELSE 1 END AS opens FROM scored),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY drone_id ORDER BY us, event_id) AS session FROM opened)
SELECT drone_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, R4((max(us) - min(us)) / 1e6) AS duration_s,
  max(altitude_m) AS max_altitude, R4(arg_min(battery_percent, us) - arg_max(battery_percent, us)) AS battery_used,
  R2(sum(CASE WHEN opens = 0 THEN hop_m ELSE 0e0 END)) AS distance_m
FROM numbered GROUP BY drone_id, session""")
def streamed_sessions(spark, sf_dir):
    s = run_scored_windows(spark, sf_dir, lambda stream: jobs.sessions_stream(stream, gap_s=30), "sessions")
    return s.select("drone_id", "start_us", "end_us", "n", "max_altitude", F.round("duration_s", 4).alias("duration_s"),
                    F.round("battery_used", 4).alias("battery_used"), F.round("distance_m", 2).alias("distance_m"))


def with_closing(spark, sf_dir, folder, tie=-1):
    """One more record, of a drone of its own, that moves the stream's time to the newest record's."""
    telemetry = fixtures.telemetry(spark, sf_dir)
    newest = telemetry.agg(F.max("us")).scalar()
    closing = telemetry.limit(1).withColumns({"us": newest + WATERMARK_US, "drone_id": F.lit("sentinel"), "event_id": F.lit(tie).cast("bigint")})
    with_time = F.expr(f"timestamp_micros(unix_micros(timestamp'{fixtures.EPOCH} 00:00:00') + us)")
    closing.withColumn("ts", with_time).select(telemetry.columns).write.mode("append").parquet(folder)


def run_silence(spark, sf_dir, make, name):
    """A job over telemetry that arrives slice by slice, restarted for each, and then only time goes on."""
    folder, target, checkpoint = (shared_dir(spark, f"{name}-{n}") for n in ("in", "out", "state"))
    jobs.use_rocksdb(spark)

    def run():
        stream = spark.readStream.schema(fixtures.telemetry(spark, sf_dir).schema).parquet(folder)
        # The stream's time is that of the records' own clock.
        stream = stream.withColumn("ts", F.timestamp_micros("us"))
        jobs.run_append(make(stream), target, checkpoint, availableNow=True).awaitTermination()

    for part in telemetry_slices(spark, sf_dir):
        part.write.mode("append").parquet(folder)
        run()
    with_closing(spark, sf_dir, folder)
    run()
    return target


# What a stream has judged when its time has come to the newest record.
REACHED = "tick <= (SELECT max(us) FROM tele)"


def _streamed_rule(name, alert, field, sql, stale_s=None):
    rule = rules.RULES[alert]

    @query(name, f"{sql} WHERE {REACHED}")
    def run(spark, sf_dir):
        watches = [alerting.Watch.of(rule, field, stale_s)]
        path = run_silence(spark, sf_dir, lambda s: alerting.alert_stream(s, watches), name)
        found = spark.read.parquet(path).filter("drone_id <> 'sentinel'")
        return found.select("drone_id", "swarm_id", "tick", "since", "state", F.round("value", 4).alias("value"))


LOW = rules.RULES["DroneBatteryLow"]
_streamed_rule("streamed_rule_battery_low", "DroneBatteryLow", "battery_percent", f"""WITH {SAMPLES},
one AS (SELECT * FROM sample WHERE metric = '{LOW.metric}'),
{grid_sql("one", "drone_id, swarm_id")}, {state_sql(f"value < {LOW.threshold}", "drone_id, swarm_id", LOW.for_s)}
SELECT drone_id, swarm_id, tick, since, state, R4(value) AS value FROM stated""")

_streamed_rule("streamed_rule_connection_lost", "DroneConnectionLost", "connected", f"""WITH {CONNECTED},
{grid_sql("link", "drone_id, swarm_id")}, {state_sql("value = 0", "drone_id, swarm_id", 15)}
SELECT drone_id, swarm_id, tick, since, state, value FROM stated""", stale_s=fleet.ACTIVE_S)


@query("streamed_stale_data", f"""WITH {TELEMETRY}, seen AS (SELECT drone_id, us AS sample_us, us::DOUBLE AS value FROM tele),
{grid_sql("seen", "drone_id", lookback=None, end="(SELECT (max(us) + 14999999) // 15000000 * 15000000 FROM tele)")}
SELECT drone_id, tick, R6((tick - sample_us) / 1e6) AS silent_s FROM grid WHERE tick - sample_us >= 60000000 AND {REACHED}""")
def streamed_stale_data(spark, sf_dir):
    watches = [alerting.silence("StaleData", 60)]
    path = run_silence(spark, sf_dir, lambda s: alerting.alert_stream(s, watches, ["drone_id"]), "stale")
    return spark.read.parquet(path).filter("drone_id <> 'sentinel'").select("drone_id", "tick", F.round("value", 6).alias("silent_s"))


@query("streamed_connection_state", f"""WITH {TELEMETRY},
seen AS (SELECT drone_id, arg_max(swarm_id, us) AS swarm_id, max(us) AS last_seen_us, arg_max(connected, us) AS c FROM tele GROUP BY drone_id)
SELECT drone_id, swarm_id, last_seen_us,
  CASE WHEN (SELECT max(us) FROM tele) - last_seen_us < 30000000 AND c THEN 1 ELSE 0 END AS connected FROM seen""")
def streamed_connection_state(spark, sf_dir):
    path = run_silence(spark, sf_dir, alerting.connection_stream, "connection")
    return alerting.current_connections(spark, path).filter("drone_id <> 'sentinel'")


@query("streamed_command_latency", f"WITH {_ASOF} SELECT event_id, drone_id, telemetry_id, R3(latency_ms) AS latency_ms FROM matched")
def streamed_command_latency(spark, sf_dir):
    """Commands and telemetry as two streams; each run's telemetry comes a run later than its commands, but in time."""
    sides = {"commands": fixtures.commands(spark, sf_dir), "telemetry": fixtures.command_side_telemetry(spark, sf_dir)}
    folders = {name: shared_dir(spark, f"asof-{name}") for name in sides}
    target, checkpoint = shared_dir(spark, "asof-out"), shared_dir(spark, "asof-state")
    jobs.use_rocksdb(spark)
    newest = fixtures.timed_events(spark, sf_dir).agg(F.max("us")).scalar()

    def run():
        streams = {n: spark.readStream.schema(df.schema).parquet(folders[n]).withColumn("ts", F.timestamp_micros("us")) for n, df in sides.items()}
        matched = joins.command_latency_stream(streams["commands"], streams["telemetry"])
        jobs.run_append(matched.drop("ts"), target, checkpoint, availableNow=True).awaitTermination()

    for i in range(SLICES):
        for name, df in sides.items():
            end = (i + 1) * SLICE_US - (WATERMARK_US // 2 if name == "telemetry" else 0)
            start = i * SLICE_US - (WATERMARK_US // 2 if name == "telemetry" else 0)
            lower, upper = (F.col("us") >= start if i else F.lit(True)), (F.col("us") < end if i + 1 < SLICES else F.lit(True))
            df.filter(lower & upper).write.mode("append").parquet(folders[name])
        run()
    closing = sides["telemetry"].limit(1).withColumns({"drone_id": F.lit("sentinel"), "us": newest + WATERMARK_US + 1000})
    closing.select(sides["telemetry"].columns).write.mode("append").parquet(folders["telemetry"])
    run()
    return spark.read.parquet(target).select("event_id", "drone_id", F.col("telemetry.event_id").alias("telemetry_id"),
                                             F.round("latency_ms", 3).alias("latency_ms"))


# The settings of every speed mode change in the middle of the run; BALANCED changes once more.
VERSIONS = f"""version AS (
  SELECT config_mode AS speed_mode, 0 AS valid_from, imgsz, target_fps FROM {_MODES} UNION ALL
  SELECT config_mode, 30000000, imgsz + 64, target_fps + 1 FROM {_MODES} UNION ALL
  SELECT config_mode, 60000000, imgsz + 128, target_fps + 2 FROM {_MODES} WHERE config_mode = 'BALANCED')"""
VERSIONED = f"""WITH {FRAMES}, {VERSIONS}
SELECT frame_no, f.speed_mode, v.imgsz, v.target_fps FROM frame f ASOF LEFT JOIN version v
ON f.speed_mode = v.speed_mode AND f.us >= v.valid_from"""


def mode_versions(spark):
    modes = lookups.speed_table(spark).select("speed_mode", "imgsz", "target_fps")
    def later(us, more, fps):
        return modes.select("speed_mode", F.lit(us).cast("bigint").alias("valid_from"), (F.col("imgsz") + more).alias("imgsz"),
                            (F.col("target_fps") + fps).alias("target_fps"))
    return later(0, 0, 0).unionByName(later(30_000_000, 64, 1)).unionByName(later(60_000_000, 128, 2).filter("speed_mode = 'BALANCED'"))


@query("speed_config_versions", VERSIONED)
def speed_config_versions(spark, sf_dir):
    found = lookups.with_version(fixtures.frames(spark, sf_dir), mode_versions(spark), "speed_mode", ["imgsz", "target_fps"])
    return found.select("frame_no", "speed_mode", "config.imgsz", "config.target_fps")


@query("streamed_speed_config_versions", VERSIONED)
def streamed_speed_config_versions(spark, sf_dir):
    """The table of changes grows between the runs of the job; a run knows those entered so far."""
    frames = fixtures.frames(spark, sf_dir)
    folder, table, target, checkpoint = (shared_dir(spark, f"modes-{n}") for n in ("in", "table", "out", "state"))
    for start, end in ((0, 30_000_000), (30_000_000, 60_000_000), (60_000_000, 1 << 60)):
        mode_versions(spark).filter(F.col("valid_from") == start).write.mode("append").parquet(table)
        frames.filter((F.col("us") >= start) & (F.col("us") < end)).write.mode("append").parquet(folder)
        jobs.run_versioned_job(spark.readStream.schema(frames.schema).parquet(folder), lambda: spark.read.parquet(table), "speed_mode",
                               ["imgsz", "target_fps"], target, checkpoint, availableNow=True).awaitTermination()
    return spark.read.parquet(target).select("frame_no", "speed_mode", "config.imgsz", "config.target_fps")


def _streamed_follow(name, locked_id):
    @query(name, follow_sql(locked_id))
    def run(spark, sf_dir):
        """Frames with their boxes come in three runs; rows of timers, which belong to no frame, are left out."""
        box = F.struct("det_idx", "det_id", "track_id", "class_name", "conf", "x1", "y1", "x2", "y2")
        frames = tracks(spark, sf_dir).groupBy("drone_id", "frame_no", "us").agg(F.collect_list(box).alias("boxes"))
        folder, target, checkpoint = (shared_dir(spark, f"follow-{n}") for n in ("in", "out", "state"))
        jobs.use_rocksdb(spark)
        third = frames.agg(F.expr("max(us) div 3")).scalar()
        for i in range(SLICES):
            upper = F.col("us") < third * (i + 1) if i + 1 < SLICES else F.lit(True)
            frames.filter((F.col("us") >= third * i) & upper).write.mode("append").parquet(folder)
            # The first frame stands at time 0, where a stream's watermark begins: its clock is a millisecond ahead.
            stream = spark.readStream.schema(frames.schema).parquet(folder).withColumn("ts", F.timestamp_micros(F.col("us") + 1000))
            jobs.run_append(following.follow_stream(stream, locked_id=locked_id), target, checkpoint, availableNow=True).awaitTermination()
        f = spark.read.parquet(target).filter("frame_no is not null")
        return f.select("drone_id", "frame_no", "state", "det_id", "track_id", "area", "reference_area",
                        *[F.round(c, 6).alias(c) for c in ("error_x", "error_y", "error_distance")])


_streamed_follow("streamed_target_following", None)
_streamed_follow("streamed_target_following_locked", 3)


@query("current_after_many_batches", f"""WITH {TELEMETRY}
SELECT drone_id, max(us) AS us, arg_max(battery_percent, (us, event_id)) AS battery_percent FROM tele GROUP BY drone_id
HAVING max(us) >= (SELECT max(us) FROM tele) - 300000000""")
def current_after_many_batches(spark, sf_dir):
    """Drones' last records kept current over a batch for each of many files; silent ones go after five minutes."""
    t = fixtures.telemetry(spark, sf_dir)
    folder, target, checkpoint = (shared_dir(spark, f"current-{n}") for n in ("in", "out", "state"))
    t.repartitionByRange(10, "us").sortWithinPartitions("us").write.parquet(folder)
    write = snapshots.keeping_current(target, ["drone_id"], every=4, keep_s=300, order="place", of=lambda batch: snapshots.last_rows(batch, ["drone_id"]))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_foreach(stream, write, checkpoint, availableNow=True).awaitTermination()
    newest = snapshots.current(spark, target, ["drone_id"], keep_s=300, order="place")
    return newest.select("drone_id", "us", "battery_percent")
