"""Time the headline queries: one JSON line with seconds per query and in total.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Every query
runs whole: its result is written to Spark's ``noop`` sink. Each is timed after one warm-up run. The health job is
run as a stream as well: rows per second, seconds to resume from its checkpoint, and the time from a record's
arrival to its score at 100 records a second.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
from pyspark.sql import SparkSession, functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from fleetlens import fixtures  # noqa: E402
from fleetlens.plans.catalog.registry import QUERIES  # noqa: E402
from fleetlens.plans.catalog.streams import arriving  # noqa: E402
from fleetlens.session import local_session, shared_dir  # noqa: E402
from fleetlens.sources import topics  # noqa: E402
from fleetlens.streaming import jobs  # noqa: E402

LIVE_S, LIVE_RATE, LIVE_FILES = 20, 100, 2  # seconds, records a second, files a second
LIVE_PARTITIONS = 2  # of the state, for five drones

HEADLINE = [
    "fleet_health_report", "health_scores", "alerts", "alert_cooldown", "tumbling_health", "sliding_trend",
    "mission_segments", "latest_gauges", "swarm_health", "latency_histogram", "rule_battery_low",
    "rule_connection_lost", "all_threshold_rules", "command_latency", "suppressed_boxes", "target_following",
    "decoded_telemetry", "compare_runs", "dataset_version",
]


def throughput(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The health job over a whole topic, and then resumed for a few late records."""
    folder, target, checkpoint = (shared_dir(spark, n) for n in ("bench-topic", "bench-health", "bench-state"))
    telemetry = fixtures.telemetry(spark, sf_dir).cache()
    topics.write_topic(topics.as_records(topics.encode_telemetry(telemetry), "telemetry"), "telemetry", folder)
    rows = telemetry.count()

    def run() -> float:
        start = time.perf_counter()
        jobs.run_health_job(arriving(spark, folder), target, checkpoint, availableNow=True).awaitTermination()
        return time.perf_counter() - start

    whole = run()
    later = telemetry.limit(100).withColumn("us", F.col("us") + 10**9).withColumn("timestamp_s", F.col("us") / 1e6)
    topics.write_topic(topics.as_records(topics.encode_telemetry(later), "telemetry"), "telemetry", folder)
    return {"streamed_rows_per_sec": round(rows / whole), "resume_sec": round(run(), 2)}


def latency(spark: SparkSession) -> dict[str, float]:
    """Arrival to score, while records arrive at a steady rate; the job runs without a trigger, its state in few partitions."""
    folder, checkpoint = shared_dir(spark, "bench-live"), shared_dir(spark, "bench-live-state")
    lags: list[float] = []

    def put(first: int, n: int) -> None:
        rows = spark.range(first, first + n).select(
            F.lit("drone.telemetry").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
            F.timestamp_micros(F.lit(int(time.time() * 1e6))).alias("timestamp"), F.lit("k").alias("key"),
            F.format_string('{"drone_id": "drone-%d", "battery_percent": 50}', F.col("id") % 5).alias("value"))
        topics.write_topic(rows.coalesce(1), "telemetry", folder)

    def score(batch, _) -> None:
        seen = [r.us for r in batch.select("us", "overall_score").collect()]
        lags.extend(time.time() - us / 1e6 for us in seen)

    put(0, 10)
    with jobs.data_batches_only(spark), jobs.state_partitions(spark, LIVE_PARTITIONS):
        query = jobs.health_stream(arriving(spark, folder)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(score).start()
    query.processAllAvailable()
    lags.clear()
    step = LIVE_RATE // LIVE_FILES
    for i in range(LIVE_S * LIVE_FILES):
        began = time.perf_counter()
        put(10 + i * step, step)
        time.sleep(max(0.0, 1 / LIVE_FILES - (time.perf_counter() - began)))
    query.processAllAvailable()
    query.stop()
    warm = np.array(lags[len(lags) // 4:])
    return {"arrival_to_score_p50": round(float(np.quantile(warm, 0.5)), 2), "arrival_to_score_p99": round(float(np.quantile(warm, 0.99)), 2)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    report = seconds["fleet_health_report"]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cores),
        "telemetry_rows": events, "scored_rows_per_sec": round(events / report),
        "streaming": {**throughput(spark, sf_dir), **latency(spark)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
