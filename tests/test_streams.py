"""Streams over several files: late rows, restarts, delivery statistics, window boundaries."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import anomalies, windows
from fleetlens.operators.cooldown import cooldown
from fleetlens.plans.catalog import streams
from fleetlens.sources import topics
from fleetlens.streaming import jobs, processor

pytestmark = pytest.mark.usefixtures("few_partitions")

S = 1_000_000
SCHEMA = ("event_id bigint, drone_id string, swarm_id string, us bigint, timestamp_s double, ts timestamp, battery_percent double, "
          "battery_voltage double, altitude_m double, velocity_ms double, latitude double, longitude double, "
          "motor_rpm array<double>, temperature_c double, signal_dbm double, connected boolean")


def frame(spark, rows):
    """Rows of (event_id, drone, second, battery, heat)."""
    full = [(i, d, "s", int(t * S), float(t), None, float(b), 22.2, 1.0, 5.0, 0.0, 0.0, [1.0] * 4, float(h), -50.0, True)
            for i, d, t, b, h in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


def feed(spark, tmp_path, batches, start):
    folder = str(tmp_path / "in")
    queries = []
    for rows in batches:
        frame(spark, rows).write.mode("append").parquet(folder)
        query = start(spark.readStream.schema(frame(spark, rows).schema).parquet(folder))
        query.awaitTermination()
        queries.append(query)
    return queries


def test_late_row_is_scored_but_changes_nothing(spark, tmp_path):
    batches = [
        [(1, "d", 100, 90, 20), (2, "d", 110, 85, 75)],
        [(3, "d", 105, 10, 20), (4, "d", 120, 84.5, 20), (5, "e", 50, 50, 20)],
        [(6, "d", 130, 80, 85)],
    ]
    out = str(tmp_path / "out")
    stats = jobs.delivery_stats(spark)
    queries = feed(spark, tmp_path, batches, lambda s: jobs.run_health_job(s, out, str(tmp_path / "ck"), availableNow=True))
    got = {r.event_id: r for r in spark.read.parquet(f"{out}/scores").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[3].late and got[3].prev is None and got[3].drain_rate is None
    assert got[4].prev.us == 110 * S and round(got[4].drain_rate, 6) == 0.05
    assert got[2].anomaly_flags == ["rapid_battery_drain", "overheating"]
    alerts = sorted((r.event_id, r.alert_type) for r in spark.read.parquet(f"{out}/alerts").collect())
    # 20 s after a warning: the critical overheating passes its 10 s, the critical drain as well
    assert alerts == [(2, "overheating"), (2, "rapid_battery_drain"), (6, "overheating"), (6, "rapid_battery_drain")]
    assert sum(stats.of(q)["messages_read"] for q in queries) == 6
    spark.streams.removeListener(stats)


def test_more_than_a_hundred_batches_are_counted(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = frame(spark, [(i, "d", i, 90, 20) for i in range(150)]).repartition(150, "event_id")
    rows.withColumn("file", F.col("event_id")).repartitionByRange(150, "file").drop("file").write.parquet(folder)
    stats = jobs.delivery_stats(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = jobs.run_append(stream.select("event_id"), out, str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination()
    assert stats.of(query)["messages_read"] == 150 and stats.totals[str(query.runId)]["batches"] > 100
    spark.streams.removeListener(stats)


def test_rows_without_a_time_do_not_stop_the_stream(spark, tmp_path):
    out = str(tmp_path / "out")
    def start(s):
        timeless = s.withColumn("us", F.when(F.col("event_id") != 2, F.col("us")))
        return jobs.run_health_job(timeless, out, str(tmp_path / "ck"), availableNow=True)
    feed(spark, tmp_path, [[(1, "d", 1, 90, 20), (2, "d", 2, 90, 20), (3, "d", 3, 89, 20)]], start)
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/scores").collect()) == [1, 3]


def test_late_rows_do_not_reach_closed_windows(spark, tmp_path):
    batches = [
        [(1, "d", 1, 90, 20), (2, "d", 30, 90, 20)],
        [(3, "d", 26, 90, 20), (4, "d", 2, 90, 20), (5, "d", 60, 90, 20)],  # 4 s late, and far too late
        [(6, "d", 200, 90, 20)],
    ]
    out = str(tmp_path / "out")

    def start(stream):
        return jobs.run_append(jobs.sliding_stream(stream, 10, 10), out, str(tmp_path / "ck"), availableNow=True)

    stats = jobs.delivery_stats(spark)
    queries = feed(spark, tmp_path, batches, start)
    got = {int(r.window_start.timestamp()): r.n for r in spark.read.parquet(out).collect()}
    assert got == {0: 1, 20: 1, 30: 1, 60: 1}
    assert sum(stats.of(q)["dropped_late"] for q in queries) == 1
    spark.streams.removeListener(stats)


def test_session_gap_is_the_same_in_both_forms(spark, tmp_path):
    rows = [(1, "d", 0, 90, 20), (2, "d", 30, 80, 20), (3, "d", 60.000001, 70, 20), (4, "e", 10, 60, 20), (5, "e", 39.5, 50, 20)]
    out = str(tmp_path / "out")

    def start(stream):
        return jobs.run_append(jobs.sessions_stream(stream, 30), out, str(tmp_path / "ck"), availableNow=True)

    feed(spark, tmp_path, [rows, [(9, "z", 9000, 1, 1)]], start)
    columns = ["drone_id", "start_us", "end_us", "n", "battery_used"]
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).filter("drone_id <> 'z'").select(columns).collect())
    batch = sorted(tuple(r) for r in windows.sessions(frame(spark, rows), gap_s=30).select(columns).collect())
    assert streamed == batch


def test_state_reaches_over_restarts_like_batch(spark, tmp_path):
    rows = [(i, f"d{i % 3}", 40 + i * 3.5, 95 - i * 0.7, 60 + i % 30) for i in range(60)]
    out = str(tmp_path / "out")
    feed(spark, tmp_path, [rows[:20], rows[20:40], rows[40:]],
         lambda s: jobs.run_health_job(s, out, str(tmp_path / "ck"), availableNow=True))
    columns = ["event_id", "overall_score", "drain_rate", "anomaly_flags"]
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{out}/scores").select(columns).collect())
    assert streamed == sorted(tuple(r) for r in anomalies.score(frame(spark, rows)).select(columns).collect())


def test_gauges_follow_the_stream(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [[(1, "d", 1, 90, 20), (2, "e", 1, 70, 20)], [(3, "d", 2, 80, 20)]]
    feed(spark, tmp_path, batches, lambda s: jobs.run_gauges_job(s, out, str(tmp_path / "ck"), availableNow=True))
    got = {r.drone_id: r.drone_battery_percent for r in jobs.current_gauges(spark, out).collect()}
    assert got == {"d": 80.0, "e": 70.0}


def test_fixes_are_judged_by_the_last_accepted_one(spark, tmp_path):
    out = str(tmp_path / "out")

    def start(stream):
        moved = stream.withColumn("latitude", F.when(F.col("event_id").isin(2, 3, 4), 1.0).otherwise(0.0))
        with jobs.data_batches_only(spark):
            return jobs.run_append(jobs.fix_stream(moved), out, str(tmp_path / "ck"), availableNow=True)

    # 1 is accepted; 2 to 4 sit 111 km away and stay rejected; 5 is back where 1 was
    feed(spark, tmp_path, [[(1, "d", 1, 90, 20), (2, "d", 2, 90, 20)], [(3, "d", 3, 90, 20)], [(4, "d", 4, 90, 20), (5, "d", 5, 90, 20)]], start)
    got = {r.event_id: r.spoofed for r in spark.read.parquet(out).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_stream_with_a_static_lookup(spark, tmp_path):
    from fleetlens.operators import lookups

    out = str(tmp_path / "out")

    def start(stream):
        named = lookups.with_class_name(stream.withColumn("cls_id", F.col("event_id")), lookups.class_table(spark))
        return jobs.run_append(named.select("event_id", "class_name"), out, str(tmp_path / "ck"), availableNow=True)

    feed(spark, tmp_path, [[(3, "d", 1, 90, 20)], [(77, "d", 2, 90, 20)]], start)
    assert {r.event_id: r.class_name for r in spark.read.parquet(out).collect()} == {3: "car", 77: "unknown"}


def test_many_drones_take_few_calls_of_the_state_step(spark, tmp_path):
    """A call of the step for each drone made the time of a batch grow with the fleet; its keys are bounded now."""
    rows = [(i, f"d{i * 7 % 900}", 40 + i // 900 * 11.5 + i % 3, 95 - i // 900 * 1.3, 60 + i % 30) for i in range(3600)]
    out = str(tmp_path / "out")
    queries = feed(spark, tmp_path, [rows[:1500], rows[1500:]],
                   lambda s: jobs.run_health_job(s, out, str(tmp_path / "ck"), availableNow=True))
    kept = queries[-1].lastProgress.stateOperators[0].numRowsTotal
    assert 0 < kept <= processor.BUCKETS
    columns = ["event_id", "overall_score", "drain_rate", "anomaly_flags"]
    want = anomalies.score(frame(spark, rows))
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{out}/scores").select(columns).collect())
    assert streamed == sorted(tuple(r) for r in want.select(columns).collect())
    alerts = ["event_id", "alert_type", "severity", "message"]
    sent = sorted(tuple(r) for r in spark.read.parquet(f"{out}/alerts").select(alerts).collect())
    assert sent == sorted(tuple(r) for r in cooldown(anomalies.alerts(want)).select(alerts).collect()) and len(sent) > 900


def judge(step, stored, now, rows):
    """Rows of (event_id, drone, second, battery, heat) through the state step at a processing time; what it adds, by record."""
    states = processor.DroneStates(stored, now)
    names = ["event_id", "drone_id", "us", "battery_percent", "temperature_c"]
    table = pa.table({**{n: [int(r[2] * S) if n == "us" else r[names.index(n)] for r in rows] for n in names},
                      **{n: [0.0] * len(rows) for n in ("latitude", "longitude", "velocity_ms", "rpm_cv")}})
    got = {r["event_id"]: (r["prev_us"], r["late"], r["emitted"]) for r in step.judged(table, states).to_pylist()}
    return got, states.stored()


def test_state_of_one_drone_expires_beside_that_of_others():
    step = processor.HealthProcessor(ttl_ms=600_000)
    got, stored = judge(step, None, 0, [(1, "d", 100, 90, 75), (2, "e", 100, 90, 20), (3, None, 90, 90, 20)])
    assert got == {1: (None, False, 8), 2: (None, False, 0), 3: (None, False, 0)}
    got, stored = judge(step, stored, 400_000, [(4, "e", 110, 90, 20), (5, None, 95, 89, 20), (6, None, 80, 89, 75)])
    assert got == {4: (100 * S, False, 0), 5: (90 * S, False, 1), 6: (None, True, 8)}
    got, stored = judge(step, stored, 600_000, [(7, "d", 105, 90, 75), (8, "e", 105, 90, 20), (9, "e", 130, 90, 20)])
    assert got == {7: (None, False, 8), 8: (None, True, 0), 9: (110 * S, False, 0)}  # d's record and cooldown are gone
    assert set(processor.DroneStates(stored, 600_000).drones) == {"d", "e", None}
    assert judge(step, stored, 2_000_000, [(10, "x", 1, 90, 20)])[0] == {10: (None, False, 0)}
    assert processor.DroneStates(judge(step, stored, 2_000_000, [(10, "x", 1, 90, 20)])[1], 2_000_000).drones == ["x"]


def test_windows_read_the_scores_where_they_lie(spark, tmp_path, monkeypatch):
    """All scores were copied once more for the second job; only the closing record is written beside them now."""
    scores = anomalies.score(frame(spark, [(i, f"d{i % 4}", 5 + i * 1.5, 95 - i * 0.7, 60 + i % 30) for i in range(40)]))
    for batch in (0, 1):
        scores.filter(F.col("event_id") % 2 == batch).write.parquet(f"{tmp_path}/health/scores/batch_id={batch}")
    folders = []
    monkeypatch.setattr(streams, "run_health", lambda *_: f"{tmp_path}/health")
    monkeypatch.setattr(streams, "shared_dir", lambda _, purpose: folders.append(purpose) or f"{tmp_path}/{purpose}")
    got = streams.run_scored_windows(spark, None, jobs.tumbling_stream, "tumbling")
    want = windows.tumbling(scores)
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(tuple(r) for r in want.collect())
    assert folders == ["tumbling-out", "tumbling-state"]
    assert spark.read.parquet(f"{tmp_path}/health/closing").count() == 1


def test_many_drones_of_a_topic_without_times(spark, tmp_path):
    """Records without a time are scored by the time they came in, in as few calls of the state step."""
    rows = spark.range(1200).selectExpr("id AS event_id", "concat('d', id % 400) AS key", "(id div 400 * 7 + 1) * 1000000L AS us")
    value = F.concat(F.lit('{"drone_id": "'), F.col("key"), F.lit('", "battery_percent": '), (90 - F.col("us") / 1e6).cast("string"), F.lit("}"))
    topics.write_topic(topics.as_records(rows.withColumn("value", value), "telemetry"), "telemetry", str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = jobs.run_health_job(streams.arriving(spark, str(tmp_path / "in")), out, str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination()
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal <= processor.BUCKETS
    got = spark.read.parquet(f"{out}/scores").select("event_id", "us", "prev.us", "drain_rate").collect()
    assert sorted(tuple(r) for r in got) == [
        (i, (i // 400 * 7 + 1) * S, (i // 400 * 7 - 6) * S if i >= 400 else None, 1.0 if i >= 400 else None) for i in range(1200)]
