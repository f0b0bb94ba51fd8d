"""Topics: keyed logs of JSON records, in Kafka or in files.

A file topic is a folder of parquet with the columns a Kafka scan has (``topic, partition,
offset, timestamp, key, value``), so everything after the scan is the same for both. It is
partitioned by topic and day, so that a topic and a span of days are read without the rest. Offsets come with
the records; nothing here makes them up.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions.columns import ColumnLike, col
from fleetlens.operators.ordered import DEFAULT_SLICE_US, with_history
from fleetlens.schemas import INFERENCE_WRITER_DEFAULTS, TOPICS, WRITER_DEFAULTS
from fleetlens.session import hadoop_folder, written
from fleetlens.sources.decode import decode

RECORD = "topic string, partition int, offset bigint, timestamp timestamp, key string, value string"
STORED = RECORD + ", day date"

#: Records from Kafka, and files of a folder, that one micro-batch takes at most.
MAX_PER_TRIGGER, MAX_FILES = 500_000, 64

# Producer settings.
PRODUCER_OPTIONS = {
    "kafka.acks": "all",
    "kafka.retries": "3",
    "kafka.retry.backoff.ms": "100",
    "kafka.linger.ms": "10",
    "kafka.batch.size": "102400",
    "kafka.compression.type": "lz4",
}


# ---- reading

def _kafka(reader, topic: str, options: dict[str, str], start: str):
    settings = {"startingOffsets": start, **options, "subscribe": TOPICS[topic].name}
    rows = reader.format("kafka").options(**settings).load()
    return rows.select("topic", "partition", "offset", "timestamp",
                       F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def scan_topic(
    spark: SparkSession, topic: str, source: str | dict[str, str], since: str | None = None
) -> DataFrame:
    """Records of a topic so far: from a folder, or from Kafka given its options.

    ``since`` (a date) leaves out the days before it, whose files are not read.
    """
    if isinstance(source, dict):
        return _kafka(spark.read, topic, source, "earliest")
    rows = spark.read.schema(STORED).parquet(source).filter(F.col("topic") == TOPICS[topic].name)
    return (rows if since is None else rows.filter(F.col("day") >= F.lit(since).cast("date"))).drop("day")


def retained(spark: SparkSession, topic: str, source: str, today: str) -> DataFrame:
    """A folder topic's records within its retention, by whole days: a partition filter."""
    kept_s = TOPICS[topic].retention_s
    if kept_s is None:
        return scan_topic(spark, topic, source)
    since = datetime.date.fromisoformat(today) - datetime.timedelta(seconds=kept_s)
    return scan_topic(spark, topic, source, since.isoformat())


def drop_expired(spark: SparkSession, topic: str, source: str, today: str) -> list[str]:
    """Delete the days of a folder topic that its retention no longer covers; returns them. Topics without a retention keep all.

    Maintenance for between runs: a reader that began before may still want the files.
    """
    kept_s = TOPICS[topic].retention_s
    files, folder = hadoop_folder(spark, f"{source}/topic={TOPICS[topic].name}")
    if kept_s is None or not files.exists(folder):
        return []
    since = (datetime.date.fromisoformat(today) - datetime.timedelta(seconds=kept_s)).isoformat()
    days = [(m[1], s.getPath()) for s in files.listStatus(folder) if (m := re.fullmatch(r"day=(\d{4}-\d\d-\d\d)", s.getPath().getName()))]
    expired = [(day, path) for day, path in days if day < since]
    for _, path in expired:
        files.delete(path, True)
    return sorted(day for day, _ in expired)


def scan_topic_stream(
    spark: SparkSession, topic: str, source: str | dict[str, str], max_per_trigger: int | None = MAX_PER_TRIGGER
) -> DataFrame:
    """New records of a topic. Kafka starts at the latest offsets; a folder is read file by file.

    A batch takes ``max_per_trigger`` records from Kafka, and ``MAX_FILES`` files from a folder, at most, so
    that the first batch over an old topic is no larger than any other. None lifts the bound.
    """
    if isinstance(source, dict):
        limits = {} if max_per_trigger is None else {"maxOffsetsPerTrigger": str(max_per_trigger)}
        return _kafka(spark.readStream, topic, {**limits, **source}, "latest")
    reader = spark.readStream.schema(STORED)
    if max_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", MAX_FILES)
    return reader.parquet(source).filter(F.col("topic") == TOPICS[topic].name).drop("day")


def with_provenance(records: DataFrame) -> DataFrame:
    """Where each record came from, as ``_meta``."""
    meta = F.struct("topic", "partition", "offset", F.unix_millis("timestamp").alias("timestamp"))
    return records.select("value", meta.alias("_meta"))


def read_topic(
    spark: SparkSession, topic: str, source: str | dict[str, str], limit: int | None = None, raw: bool = False
) -> DataFrame:
    """Decoded records with ``_meta``; with ``limit``, the first that many which decode. ``raw`` as in :func:`decode`."""
    records = with_provenance(scan_topic(spark, topic, source))
    return decode(records, topic, raw=raw)[0] if limit is None else first_decoded(records, topic, limit, raw)


def first_decoded(records: DataFrame, topic: str, n: int, raw: bool = False) -> DataFrame:
    """The first ``n`` records that decode, by partition and offset, without decoding the others.

    Somewhat more than ``n`` records are taken in their order, each task handing over that many at most, and decoded;
    if too few of them are good, four times as many are, until there are enough or no more.
    """
    taken = max(2 * n, 100)
    while True:
        some = written(records.orderBy("_meta.partition", "_meta.offset").limit(taken), "first-records")
        good, _ = decode(some, topic, raw=raw)
        if good.limit(n).count() >= n or some.count() < taken:
            return first_messages(good, n)
        taken *= 4


def read_rejects(spark: SparkSession, topic: str, source: str | dict[str, str]) -> DataFrame:
    """The records that :func:`read_topic` leaves out, with the reason."""
    return decode(with_provenance(scan_topic(spark, topic, source)), topic)[1]


def first_messages(good: DataFrame, n: int) -> DataFrame:
    return good.orderBy("_meta.partition", "_meta.offset").limit(n)


def read_topic_stream(
    spark: SparkSession, topic: str, source: str | dict[str, str], max_per_trigger: int | None = MAX_PER_TRIGGER,
    raw: bool = False,
) -> DataFrame:
    records = with_provenance(scan_topic_stream(spark, topic, source, max_per_trigger))
    return decode(records, topic, raw=raw)[0]


def read_rejects_stream(
    spark: SparkSession, topic: str, source: str | dict[str, str], max_per_trigger: int | None = MAX_PER_TRIGGER
) -> DataFrame:
    """New records that cannot be decoded, for a sink of their own (``jobs.run_append``)."""
    return decode(with_provenance(scan_topic_stream(spark, topic, source, max_per_trigger)), topic)[1]


# ---- encoding

def record(key: ColumnLike, fields: dict[str, Column]) -> list[Column]:
    """Key and JSON value of a record."""
    value = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
    return [col(key).alias("key"), value.alias("value")]


def encode_telemetry(df: DataFrame, at: ColumnLike = "timestamp_s") -> DataFrame:
    """Telemetry records. Missing values get the writer's defaults, position is nested."""
    def field(name: str) -> Column:
        default = F.lit(WRITER_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in df.columns else default

    idle = F.array(*[F.lit(0.0)] * 4)
    rpm = F.coalesce(F.col("motor_rpm"), idle) if "motor_rpm" in df.columns else idle
    fields = {"drone_id": F.col("drone_id"), "swarm_id": field("swarm_id"), "timestamp": col(at)}
    fields |= {n: field(n) for n in ("battery_percent", "battery_voltage", "altitude_m", "velocity_ms")}
    fields["position"] = F.struct(field("latitude").alias("lat"), field("longitude").alias("lon"))
    fields["motor_rpm"] = F.when(F.size(rpm) > 0, rpm).otherwise(idle)
    fields |= {n: field(n) for n in ("temperature_c", "signal_dbm", "connected")}
    return df.select(*_carried(df), *record("drone_id", fields))


def gather_detections(boxes: DataFrame, frame: list[str]) -> DataFrame:
    """The boxes of a frame as one array, in ``det_idx`` order."""
    item = F.struct(
        "det_idx", F.col("track_id"), F.col("class_name").alias("class"), F.col("conf").alias("confidence"),
        F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
    )
    boxes_of = F.transform(F.sort_array(F.collect_list(item)), lambda d: d.dropFields("det_idx"))
    return boxes.groupBy(*frame).agg(boxes_of.alias("detections"))


def encode_inference(df: DataFrame, at: ColumnLike = "timestamp_s") -> DataFrame:
    """Inference records from rows with a ``detections`` array."""
    def field(name: str) -> Column:
        default = F.lit(INFERENCE_WRITER_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in df.columns else default

    empty = F.array().cast(TOPICS["inference"].schema["detections"].dataType)
    fields = {"drone_id": F.col("drone_id"), "timestamp": col(at)}
    fields |= {n: field(n) for n in ("model_name", "speed_mode", "latency_s", "fps")}
    fields["detections"] = F.coalesce(F.col("detections"), empty)
    return df.select(*_carried(df), *record("drone_id", fields))


def encode_command(df: DataFrame, at: ColumnLike = "timestamp_s", issued_by: str = "langgraph") -> DataFrame:
    given = F.col("parameters") if "parameters" in df.columns else F.lit(None)
    parameters = F.coalesce(given.cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    by = F.coalesce(F.col("issued_by"), F.lit(issued_by)) if "issued_by" in df.columns else F.lit(issued_by)
    return df.select(*_carried(df), *record("drone_id", {
        "drone_id": F.col("drone_id"), "timestamp": col(at), "command": F.col("command"),
        "parameters": parameters, "issued_by": by,
    }))


def encode_battery_event(df: DataFrame, at: ColumnLike = "timestamp_s") -> DataFrame:
    return df.select(*_carried(df), *record("drone_id", {
        "drone_id": F.col("drone_id"), "timestamp": col(at), "event_type": F.col("event_type"),
        "battery_percent": F.col("battery_percent"), "details": F.coalesce("details", F.lit("")),
    }))


def encode_plain(df: DataFrame, topic: str, at: ColumnLike = "timestamp_s") -> DataFrame:
    """Scores and alerts: the schema's fields under their names."""
    fields = {f.name: col(at) if f.name == "timestamp" else F.col(f.name) for f in TOPICS[topic].schema.fields}
    return df.select(*_carried(df), *record("drone_id", fields))


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("event_id", "us") if c in df.columns]


ENCODERS = {
    "telemetry": encode_telemetry, "inference": encode_inference,
    "commands": encode_command, "battery_events": encode_battery_event,
}


def encode(df: DataFrame, topic: str, at: ColumnLike = "timestamp_s") -> DataFrame:
    """``key`` and ``value`` of every row, in the topic's wire form."""
    return ENCODERS[topic](df, at) if topic in ENCODERS else encode_plain(df, topic, at)


# ---- writing

def partition_of(key: ColumnLike, partitions: int) -> Column:
    """The partition a key belongs to; all records of a key share one."""
    return F.pmod(F.hash(col(key)), F.lit(partitions))


def partition_by_key(df: DataFrame, topic: str, key: str = "drone_id") -> DataFrame:
    """Distribute rows by key into the topic's number of partitions. Order comes from a sort key."""
    return df.repartition(TOPICS[topic].partitions, key)


def as_log(encoded: DataFrame, topic: str, partition: Column | None = None, width_us: int = DEFAULT_SLICE_US) -> DataFrame:
    """Encoded rows as the records of a topic written at one go, with offsets in the order of (us, event_id).

    For fixtures: a real topic's offsets come from its broker.
    """
    spec = TOPICS[topic]
    placed = encoded.withColumn(
        "partition", (partition_of("key", spec.partitions) if partition is None else partition).cast("int")
    )
    counted = with_history(placed, ["partition"], "us", "event_id", position="_pos", width=width_us)
    return counted.select(
        F.lit(spec.name).alias("topic"), "partition", (F.col("_pos") - 1).alias("offset"),
        F.timestamp_micros("us").alias("timestamp"), "key", "value",
    )


def as_records(encoded: DataFrame, topic: str, offset: ColumnLike = "event_id", us: ColumnLike = "us") -> DataFrame:
    """Encoded rows as topic records whose offset and time are given columns."""
    spec = TOPICS[topic]
    return encoded.select(
        F.lit(spec.name).alias("topic"), partition_of("key", spec.partitions).cast("int").alias("partition"),
        col(offset).cast("bigint").alias("offset"), F.timestamp_micros(col(us)).alias("timestamp"), "key", "value",
    )


def _stored(records: DataFrame) -> DataFrame:
    return records.withColumn("day", F.to_date("timestamp"))


def write_topic(encoded: DataFrame, topic: str, target: str | dict[str, str]) -> None:
    """Append encoded rows to Kafka given its options, or topic records, offsets included, to a folder."""
    if isinstance(target, dict):
        out = encoded.select("key", "value").write.format("kafka")
        out.options(**PRODUCER_OPTIONS, **target).option("topic", TOPICS[topic].name).save()
    elif "offset" not in encoded.columns:
        raise ValueError("a folder topic takes records with their offsets; see as_records")
    else:
        _stored(encoded).write.mode("append").partitionBy("topic", "day").parquet(target)


def write_topic_stream(encoded: DataFrame, topic: str, target: str | dict[str, str], checkpoint: str):
    """Stream encoded rows to Kafka at least once, or topic records to a folder exactly once."""
    def writer(rows: DataFrame):
        return rows.writeStream.option("checkpointLocation", checkpoint).queryName(f"to-{topic}")

    if isinstance(target, dict):
        out = writer(encoded.select("key", "value")).format("kafka").options(**PRODUCER_OPTIONS, **target)
        return out.option("topic", TOPICS[topic].name)
    if "offset" not in encoded.columns:
        raise ValueError("a folder topic takes records with their offsets; see as_records")
    return writer(_stored(encoded)).format("parquet").partitionBy("topic", "day").option("path", target)
