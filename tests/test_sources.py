"""Decoding, topics, file trees and logs."""

import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import datasets, logs, normalise
from fleetlens.operators.commands import ROUTES, TOOL_ROUTES, route
from fleetlens.schemas import TOPICS
from fleetlens.sources import decode, files, topics

GOOD = '{"drone_id": "d1", "swarm_id": "s", "timestamp": 1.5, "battery_percent": 50, "position": {"lat": 1, "lon": 2}, "motor_rpm": [1, 2, 3, 4], "connected": true}'
CORPUS = {
    "good": GOOD,
    "syntax": '{"drone_id": "d1"',
    "empty": "",
    "array": '[{"drone_id": "d1"}]',
    "number": "5",
    "null": "null",
    "string in a number": '{"drone_id": "d1", "battery_percent": "high"}',
    "no id": '{"swarm_id": "s"}',
    "null id": '{"drone_id": null}',
    "null fields": '{"drone_id": "d2", "timestamp": 2.0, "battery_percent": null, "position": null, "motor_rpm": null}',
    "extra field": '{"drone_id": "d3", "timestamp": 3.0, "other": [1, {"a": 2}]}',
}


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame(list(CORPUS.items()), "case string, value string")


def test_rejects(corpus):
    good, bad = decode.decode_telemetry(corpus)
    assert {r.case for r in good.collect()} == {"good", "null fields", "extra field"}
    assert {r.case: r.error_type for r in bad.collect()} == {
        "syntax": "json_decode", "empty": "json_decode", "array": "processing", "number": "processing",
        "null": "processing", "string in a number": "processing", "no id": "processing", "null id": "processing",
    }
    assert {r.case: r.value for r in bad.collect()} == {k: v for k, v in CORPUS.items() if k in {r.case for r in bad.collect()}}


def test_defaults(corpus):
    rows = {r.case: r for r in decode.decode_telemetry(corpus)[0].collect()}
    assert rows["good"].motor_rpm == [1.0, 2.0, 3.0, 4.0] and rows["good"].us == 1_500_000
    empty = rows["null fields"]
    assert (empty.swarm_id, empty.battery_percent, empty.latitude, empty.signal_dbm, empty.connected) == ("default", 0.0, 0.0, -100.0, False)
    assert empty.motor_rpm == [0.0] * 4


def test_missing_time_is_ingest_time(spark):
    df = spark.createDataFrame([('{"drone_id": "d"}',)], "value string").withColumn("seen", F.timestamp_micros(F.lit(7_000_000)))
    assert decode.decode_telemetry(df, ingest_ts="seen")[0].first().us == 7_000_000


def test_inference_names(spark):
    rows = [('{"model": "m", "detections": [{"class": null, "bbox": [1, 2, 3, 4]}, {}]}',), ('{"drone_id": "d"}',)]
    good, bad = decode.decode_inference(spark.createDataFrame(rows, "value string"))
    got = {r.drone_id: (r.model_name, r.speed_mode, len(r.detections)) for r in good.collect()}
    assert got == {"unknown": ("m", "unknown", 2), "d": ("unknown", "unknown", 0)} and bad.count() == 0
    boxes = decode.detection_table(good).orderBy("det_idx").collect()
    assert [(b.class_name, b.x2) for b in boxes] == [("unknown", 3.0), ("unknown", None)]


def test_topic_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, f"d{i % 3}", i * 1_000_000, i / 1.0) for i in range(20)],
                               "event_id bigint, drone_id string, us bigint, battery_percent double")
    df = df.withColumn("timestamp_s", F.col("us") / 1e6)
    folder = str(tmp_path / "topic")
    records = topics.as_records(topics.encode(df, "telemetry"), "telemetry")
    for half in (0, 1):  # a second append repeats no offset
        topics.write_topic(records.filter(F.col("offset") % 2 == half), "telemetry", folder)
    assert topics.scan_topic(spark, "telemetry", folder).select("partition", "offset").distinct().count() == 20
    back = topics.read_topic(spark, "telemetry", folder)
    assert sorted((r.drone_id, r.us, r.battery_percent) for r in back.collect()) == sorted((f"d{i % 3}", i * 10**6, float(i)) for i in range(20))
    assert back.select("drone_id", "_meta.partition").distinct().count() == 3
    first = topics.read_topic(spark, "telemetry", folder, limit=5).collect()
    assert len(first) == 5 and [r._meta.offset for r in first] == sorted(r._meta.offset for r in first)
    with pytest.raises(ValueError, match="offsets"):
        topics.write_topic(topics.encode(df, "telemetry"), "telemetry", folder)


def test_a_topic_and_a_day_are_read_alone(spark, tmp_path):
    rows = [(i, f"d{i}", i * 86_400_000_000, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id bigint, drone_id string, us bigint, battery_percent double").withColumn("timestamp_s", F.col("us") / 1e6)
    folder = str(tmp_path / "topic")
    topics.write_topic(topics.as_records(topics.encode(df, "telemetry"), "telemetry"), "telemetry", folder)
    kept = topics.retained(spark, "telemetry", folder, "1970-01-04")
    assert sorted(r.offset for r in kept.collect()) == [2, 3]
    plan = kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("],")[0]
    assert "topic" in plan and "day" in plan


def test_every_record_is_decoded_or_quarantined(spark, corpus, tmp_path):
    records = corpus.select(
        F.lit("drone.telemetry").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"),
        F.timestamp_micros(F.lit(9_000_000)).alias("timestamp"), F.lit("k").alias("key"), "value")
    timeless = records.limit(1).select(
        "topic", "partition", F.lit(99).cast("bigint").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"), "key",
        F.lit('{"drone_id": "d9"}').alias("value"))
    late = records.limit(1).select("topic", "partition", F.lit(98).cast("bigint").alias("offset"), "timestamp", "key",
                                   F.lit('{"drone_id": "d8"}').alias("value"))
    good, bad = decode.decode(topics.with_provenance(records.union(timeless).union(late)), "telemetry")
    assert good.count() + bad.count() == len(CORPUS) + 2
    times = {r.drone_id: r.us for r in good.collect()}
    assert times["d8"] == 9_000_000 and None not in times.values() and "d9" not in times
    from fleetlens.operators import anomalies
    scored = anomalies.score(good.withColumn("event_id", F.col("_meta.offset")))
    assert scored.count() == good.count()


def test_absent_fields_stay_absent_in_raw_form(spark):
    df = spark.createDataFrame([('{"drone_id": "d", "battery_percent": 80, "motor_rpm": [9, 9, 9, 9], "timestamp": 1}', 1),
                                ('{"drone_id": "d", "timestamp": 2}', 2)], "value string, event_id bigint")
    raw, _ = decode.decode(df, "telemetry", raw=True)
    from fleetlens.operators import fleet
    assert fleet.gauges_wide(raw).first().drone_battery_percent == 80.0
    assert {r.value for r in fleet.motor_gauges(raw).collect()} == {9.0}


def test_kafka_is_asked_for_by_its_options(spark):
    with pytest.raises(Exception, match="kafka"):
        topics.scan_topic(spark, "telemetry", {"kafka.bootstrap.servers": "unused"})


def test_file_tree(spark, tmp_path):
    for path, text in {"train/images/a.jpg": "x", "train/images/b.JPG": "yy", "train/labels/a.txt": "z", "README": "r"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    scanned = files.scan_files(spark, str(tmp_path))
    stats = datasets.dataset_stats(scanned).first()
    assert (stats.total_files, stats.file_types) == (4, {"": 1, ".jpg": 2, ".txt": 1})
    assert {r.directory for r in datasets.subdirectories(scanned).collect()} == {"train", "train/images", "train/labels"}
    hashed = datasets.file_hashes(files.scan_files(spark, str(tmp_path), content=True))
    assert {r.path: r.md5 for r in hashed.collect()}["README"] == "4b43b0aee35624cd95b910189b3dc231"
    before = datasets.dataset_version(hashed).first().version
    (tmp_path / "README").write_text("changed")
    after = datasets.file_hashes(files.scan_files(spark, str(tmp_path), content=True))
    assert datasets.dataset_version(after).first().version != before
    listed = datasets.image_label_files(scanned)
    assert [(r.split, r.images, r.labels) for r in datasets.split_counts(listed).collect()] == [("train", 1, 1)]


def test_listing_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = files.scan_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_log_folder(spark, tmp_path):
    (tmp_path / "bridge-1_prod_main-00ff.log").write_text('{"drone_id": "d", "severity": "critical", "k": 1}\nplain\n')
    got = files.scan_logs(spark, str(tmp_path)).withColumn("app", F.lit("fleet"))
    assert {(r.pod, r.namespace, r.container) for r in got.collect()} == {("bridge-1", "prod", "main")}
    assert [r.message[:1] for r in logs.search(logs.parse_json_logs(got), "d", "critical").collect()] == ["{"]


def test_daily_table(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00")], "message string, t string")
    path = str(tmp_path / "logs")
    logs.write_daily(df.withColumn("ts", F.to_timestamp("t")), path)
    day = spark.read.parquet(path).filter("log_date = date'2024-01-02'")
    assert [r.index_name for r in day.collect()] == ["fleet-logs-2024.01.02"]
    assert "PartitionFilters: [isnotnull(log_date" in day._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text, plain, tools", [
    ("CHECK the sky", "analyst", "analyst"), ("please scan", "analyst", "end"), ("what status", "end", "analyst"),
    ("Engage and check", "analyst", "analyst"), ("execute it", "tactical", "end"), ("land now", "end", "tactical"),
    ("tactical", "tactical", "tactical"), ("hello", "end", "end"),
])
def test_routing(spark, text, plain, tools):
    row = spark.range(1).select(route(F.lit(text), ROUTES), route(F.lit(text), TOOL_ROUTES)).first()
    assert tuple(row) == (plain, tools)


def test_tool_calls_go_first(spark):
    assert spark.range(1).select(route(F.lit("check"), TOOL_ROUTES, F.lit(True))).first()[0] == "tools"


def test_local_frame(spark):
    df = spark.createDataFrame([(7, 1000.0, 2000.0, -3.0, 3.0, 0.0, 4.0, 0.0, 22.0, [1.0] * 4)],
                               "entity_id int, x double, y double, z double, vx double, vy double, vz double, "
                               "battery_level double, battery_voltage_current double, motor_speeds array<double>")
    r = normalise.from_local_frame(df).first()
    assert (r.drone_id, r.velocity_ms, r.altitude_m, r.temperature_c, r.signal_dbm, r.connected) == ("drone-007", 5.0, 0.0, 27.5, -40.0, False)


def test_first_records_that_decode_among_many_that_do_not(spark):
    good = '{"drone_id": "d%d", "timestamp": 1}'
    rows = [("drone.telemetry", i % 3, i, None, "k", good % i if i % 50 == 49 else "broken") for i in range(1500)]
    records = topics.with_provenance(spark.createDataFrame(rows, topics.RECORD))
    def first(n):
        return [(r._meta.partition, r._meta.offset) for r in topics.first_decoded(records, "telemetry", n).collect()]
    want = sorted((i % 3, i) for i in range(1500) if i % 50 == 49)
    assert sorted(first(4)) == want[:4] and sorted(first(25)) == want[:25] and sorted(first(99)) == want and first(0) == []


def test_expired_days_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = [("drone.telemetry", 0, d, datetime.datetime(2024, 1, d, 12), "k", '{"drone_id": "d", "timestamp": 1}') for d in range(1, 21)]
    records = spark.createDataFrame(rows, topics.RECORD)
    topics.write_topic(records, "telemetry", folder)
    kept_days = TOPICS["telemetry"].retention_s // 86_400
    before = sorted(r.offset for r in topics.retained(spark, "telemetry", folder, "2024-01-20").collect())
    gone = topics.drop_expired(spark, "telemetry", folder, "2024-01-20")
    assert gone == [f"2024-01-{d:02}" for d in range(1, 20 - kept_days)]
    assert sorted(r.offset for r in topics.scan_topic(spark, "telemetry", folder).collect()) == before == list(range(20 - kept_days, 21))
    assert topics.drop_expired(spark, "telemetry", folder, "2024-01-20") == [] == topics.drop_expired(spark, "alerts", str(tmp_path / "none"), "2024-01-20")


def test_broker_errors_are_counted_apart():
    from types import SimpleNamespace

    from fleetlens.streaming.jobs import DeliveryStats

    stats = DeliveryStats()
    for run, told in (("a", None), ("b", "org.apache.kafka.common.errors.TimeoutException: no node"), ("c", "java.lang.ArithmeticException")):
        stats.onQueryTerminated(SimpleNamespace(runId=run, exception=told))
    errors = {run: (c["delivery_errors"], c["kafka_error"]) for run, c in stats.totals.items()}
    assert errors == {"a": (0, 0), "b": (1, 1), "c": (1, 0)}
