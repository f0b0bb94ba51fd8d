"""Streaming jobs: health scores and cooled alerts, windows, latest values."""

from __future__ import annotations

import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from fleetlens.functions.health import motor_cv, motor_mean
from fleetlens.operators import anomalies, fleet, lookups, windows
from fleetlens.operators.windows import WATERMARK
from fleetlens.sources import topics
from fleetlens.sources.decode import KAFKA_ERROR
from fleetlens.streaming import snapshots
from fleetlens.streaming.processor import KINDS, PREV, FixFilter, with_drone_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def data_batches_only(spark: SparkSession) -> Iterator[None]:
    """Start a query that runs no batches without data.

    A stateful step with expiry by processing time asks for another batch forever, so an
    ``availableNow`` run would never end. A query copies the settings when it starts.
    """
    before = spark.conf.get(NO_DATA_BATCHES, "true")
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


@contextmanager
def state_partitions(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Start a query whose state has ``n`` partitions (None: as many as the session shuffles into).

    A checkpoint keeps the number it began with. Every partition costs each micro-batch a fixed time, a Python
    step and a commit, so a fleet that one or two tasks can serve is scored sooner with one or two.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if n is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory, with state expiry; needed by the stateful step."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def health_stream(telemetry: DataFrame, ttl_s: int = anomalies.STATE_TTL_S) -> DataFrame:
    """Scored telemetry with ``emitted``, the alert types of a record that pass the cooldown.

    One shuffle by bucket of drones. Works on a stream of decoded telemetry with ``event_id``, ``us``.
    """
    use_rocksdb(telemetry.sparkSession)
    # Decoded records have a time, or they were quarantined; order means nothing without one.
    timed = telemetry.filter(F.col("us").isNotNull()).withColumn("rpm_mean", motor_mean("motor_rpm"))
    keyed = timed.withColumn("rpm_cv", motor_cv("motor_rpm", "rpm_mean")).drop("rpm_mean")
    stated = with_drone_state(keyed, ttl_s * 1000)
    fields = dict(zip(anomalies.PREVIOUS_FIELDS, PREV))
    previous = F.when(F.col("prev_us").isNotNull(), F.struct(*[F.col(v).alias(k) for k, v in fields.items()]))
    rows = stated.withColumn("prev", previous).drop(*PREV)
    return anomalies.add_scores(anomalies.add_delta_columns(rows, ttl_s))


def fix_stream(telemetry: DataFrame, max_speed_ms: float = 30.0, ttl_s: int = anomalies.STATE_TTL_S) -> DataFrame:
    """Telemetry with ``spoofed``, judged against the last accepted fix; start it inside :func:`data_batches_only`."""
    use_rocksdb(telemetry.sparkSession)
    schema = StructType([*telemetry.schema.fields, *StructType.fromDDL("spoofed boolean").fields])
    return telemetry.groupBy("drone_id").transformWithStateInPandas(
        FixFilter(telemetry.columns, max_speed_ms, ttl_s * 1000), schema, "Append", "ProcessingTime"
    )


def cooled_alerts(scored: DataFrame) -> DataFrame:
    """Alert rows of scored stream records, kept only where the cooldown let them pass."""
    every = anomalies.alerts(scored.filter(F.size("emitted") > 0), also=["emitted"])
    return every.filter(F.array_contains("emitted", F.col("alert_type"))).drop("emitted")


def write_outputs(target: str) -> Callable[[DataFrame, int], None]:
    """Scores, flagged scores and cooled alerts of a micro-batch, each under its batch id.

    The batch is scored once: flagged scores and alerts are taken from the scores as written. A repeated batch
    overwrites its own folder, so a restart after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def out(df: DataFrame, name: str) -> str:
            path = f"{target}/{name}/batch_id={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return path

        scores = batch.sparkSession.read.schema(batch.schema).parquet(out(batch, "scores"))
        out(anomalies.flagged(scores), "flagged")
        out(cooled_alerts(scores), "alerts")

    return write


def run_health_job(telemetry: DataFrame, target: str, checkpoint: str, ttl_s: int = anomalies.STATE_TTL_S,
                   partitions: int | None = None, **trigger) -> StreamingQuery:
    """Start the health job; ``availableNow=True`` processes what is there and stops.

    Without a trigger a batch starts as soon as the one before is done, so a score waits for one batch.
    ``partitions`` as in :func:`state_partitions`.
    """
    writer = _triggered(
        health_stream(telemetry, ttl_s).writeStream.queryName("health")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_outputs(target)), trigger)
    with data_batches_only(telemetry.sparkSession), state_partitions(telemetry.sparkSession, partitions):
        return writer.start()


def run_health_to_topics(
    telemetry: DataFrame, target: str | dict[str, str], checkpoint: str, **trigger
) -> StreamingQuery:
    """As :func:`run_health_job`, with scores, cooled alerts and flagged scores sent each to its topic, at least once.

    Into a folder, a record's offset is that of the telemetry it follows from; the up to four alerts of one
    record count on from four times that.
    """
    def send(rows: DataFrame, topic: str, offset: str = "event_id") -> None:
        encoded = topics.encode(rows, topic)
        topics.write_topic(encoded if isinstance(target, dict) else topics.as_records(encoded, topic, F.expr(offset)), topic, target)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            send(batch, "metrics")
            send(anomalies.flagged(batch), "flagged")
            kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("alert_type")) - 1
            send(cooled_alerts(batch).withColumn("event_id", F.col("event_id") * 4 + kind), "alerts")
        finally:
            batch.unpersist()

    writer = _triggered(
        health_stream(telemetry).writeStream.queryName("health-topics").option("checkpointLocation", checkpoint)
        .foreachBatch(write), trigger)
    with data_batches_only(telemetry.sparkSession):
        return writer.start()


def _triggered(writer: DataStreamWriter, trigger: dict) -> DataStreamWriter:
    return writer.trigger(**trigger) if trigger else writer


def run_gauges_job(telemetry: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the latest gauges of the fleet: a batch writes the drones it heard of, under its id.

    Feed it raw telemetry (``read_topic_stream(raw=True)``): an absent field leaves its gauge as it was. The
    state is one row per drone, however long the stream runs, and so is what readers of :func:`current_gauges` meet.
    """
    write = snapshots.keeping_current(target, ["drone_id", "swarm_id"])
    return _triggered(
        fleet.gauges_wide(telemetry).writeStream.queryName("gauges").outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(write), trigger).start()


def current_gauges(spark: SparkSession, target: str) -> DataFrame:
    """The gauges as last written, merged by drone and swarm."""
    return snapshots.current(spark, target, ["drone_id", "swarm_id"]).drop("batch_id")


def run_swarm_job(telemetry: DataFrame, target: str, checkpoint: str, active_s: float = fleet.ACTIVE_S, **trigger) -> StreamingQuery:
    """Swarm state by the last records of all drones so far: active drones and health per swarm, every batch.

    State is one row per drone; what is written per batch is one row per swarm, under the batch's id. The
    clock is the newest record's time.
    """
    write = snapshots.keeping_current(target, ["swarm_id"], of=lambda batch: fleet.swarm_of(batch, active_s=active_s))
    return _triggered(
        fleet.last_records(telemetry).writeStream.queryName("swarms").outputMode("complete")
        .option("checkpointLocation", checkpoint).foreachBatch(write), trigger).start()


def run_inference_metrics_job(inference: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Latency histogram, latest frame rate and detection counts, kept up to date by inference records.

    Each metric is a running aggregate per drone and model (or class). A batch writes the groups it
    changed; :func:`current` gives the newest of each.
    """
    counted = fleet.inference_totals(inference)
    write = snapshots.keeping_current(target, ["drone_id", "model_name", "speed_mode"])
    return _triggered(
        counted.writeStream.queryName("inference-metrics").outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(write), trigger).start()


def run_versioned_job(
    rows: DataFrame, versions: Callable[[], DataFrame], key: str, fields: list[str], target: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write a stream with the version of its configuration that held at each row's time.

    ``versions`` reads the table of changes; it is called for every batch, so changes are seen without a restart.
    A batch writes its rows under its id. A change that is entered later than rows it would concern does not
    reach back to them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        lookups.with_version(batch, versions(), key, fields).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return _triggered(rows.writeStream.queryName("versioned").option("checkpointLocation", checkpoint).foreachBatch(write), trigger).start()


def current(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Per key, the row of the newest batch that wrote it."""
    return snapshots.current(spark, target, keys).drop("batch_id")


def watermarked(df: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return df.withWatermark("ts", delay)


def run_foreach(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hand every batch of a stream to ``write``, which must give the same result when a batch is repeated."""
    return _triggered(df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), trigger).start()


def run_append(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a windowed stream exactly once; a window is written when the watermark has passed it."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    return _triggered(writer.option("checkpointLocation", checkpoint), trigger).start()


def tumbling_stream(scored: DataFrame, size_s: int = 10, delay: str = WATERMARK) -> DataFrame:
    return windows.tumbling(watermarked(scored, delay), size_s)


def sliding_stream(df: DataFrame, size_s: int = 60, slide_s: int = 10, delay: str = WATERMARK) -> DataFrame:
    return windows.sliding_stream(watermarked(df, delay), size_s, slide_s)


def sessions_stream(df: DataFrame, gap_s: int = 300, delay: str = WATERMARK) -> DataFrame:
    return windows.sessions_stream(watermarked(df, delay), gap_s)


class DeliveryStats(StreamingQueryListener):
    """Records read, rows that came too late, and errors, those of the broker apart, per query, over all of its batches.

    Register it with ``spark.streams.addListener`` before the query starts; a query's own progress keeps
    its last hundred batches only.
    """

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = defaultdict(Counter)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.totals[str(progress.runId)].update({
            "batches": 1, "messages_read": progress.numInputRows,
            "dropped_late": sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        told = event.exception or ""
        broker = "org.apache.kafka" in told or "KafkaException" in told
        self.totals[str(event.runId)].update({"ended": 1, "delivery_errors": int(bool(told)), KAFKA_ERROR: int(broker)})

    def of(self, query: StreamingQuery, wait_s: float = 10.0) -> dict[str, int]:
        """A query's totals. Events come a little later than they happen: those of an ended query are waited for."""
        until = time.monotonic() + wait_s
        totals = self.totals[str(query.runId)]
        while not query.isActive and not totals["ended"] and time.monotonic() < until:
            time.sleep(0.05)
        return {name: totals[name] for name in ("messages_read", "dropped_late", "delivery_errors", KAFKA_ERROR)}


def delivery_stats(spark: SparkSession) -> DeliveryStats:
    """Start counting: the statistics of all queries of the session from now on."""
    stats = DeliveryStats()
    spark.streams.addListener(stats)
    return stats
