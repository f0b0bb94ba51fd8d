"""Decoding of JSON records into typed tables, with rejects kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetlens.functions.columns import micros
from fleetlens.schemas import READER_DEFAULTS, TOPICS

CORRUPT = "_corrupt_record"

# Error types of the error counter.
SYNTAX_ERROR, PROCESSING_ERROR = "json_decode", "processing"
#: Failures of the broker's client; they end a query, and are counted by ``jobs.DeliveryStats``.
KAFKA_ERROR = "kafka_error"


def ingest_us(df: DataFrame, ingest_ts: str | None = None) -> Column:
    """When a record came in, in microseconds: a named column, ``_meta`` of a topic, or a topic's ``timestamp``."""
    if ingest_ts is not None:
        return F.unix_micros(F.col(ingest_ts))
    kinds = dict(df.dtypes)
    if "_meta" in kinds:
        return F.col("_meta.timestamp") * F.lit(1000)
    return F.unix_micros("timestamp") if kinds.get("timestamp") == "timestamp" else F.lit(None).cast("bigint")


def parse(
    df: DataFrame, topic: str, value: str = "value", required: str | None = "drone_id", timed: Column | None = None
) -> DataFrame:
    """Add ``record`` and ``error_type``, which is null for records that could be read.

    Bad syntax is a ``json_decode`` error. A value that is no object, a field of the wrong type
    or a missing required field is a ``processing`` error, and so is a record without a time where
    ``timed``, the time it came in, is given and null as well.
    """
    schema = T.StructType([*TOPICS[topic].schema.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    bad = F.col(f"record.{CORRUPT}").isNotNull() | F.col("record").isNull() | ~F.ltrim(value).startswith("{")
    if required:
        bad = bad | F.col(f"record.{required}").isNull()
    if timed is not None:
        bad = bad | F.coalesce(micros("record.timestamp"), timed).isNull()
    syntax = F.try_parse_json(value).isNull()
    # Through a generator, as Spark would otherwise push the filter on errors below the parsing
    # and parse every value once more for each condition in it.
    parsed = df.select("*", F.explode(F.array(record)).alias("record"))
    return parsed.withColumn("error_type", F.when(bad, F.when(syntax, SYNTAX_ERROR).otherwise(PROCESSING_ERROR)))


def quarantine(parsed: DataFrame, value: str = "value") -> DataFrame:
    """Records that could not be read, in full, with the reason."""
    kept = [c for c in parsed.columns if c not in ("record", "error_type")]
    return parsed.filter(F.col("error_type").isNotNull()).select(*kept, "error_type")


def error_counts(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def _good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error_type").isNull())


def _passed_on(parsed: DataFrame, value: str) -> list[Column]:
    """Columns of the source record (offset, key, ...) that stay beside the decoded fields."""
    taken = {"record", "error_type", value, "us", "ts", "timestamp_s"}
    taken |= {f.name for f in parsed.schema["record"].dataType.fields} | {"latitude", "longitude"}
    return [F.col(c) for c in parsed.columns if c not in taken]


def telemetry_fields(
    parsed: DataFrame, value: str = "value", ingest_ts: str | None = None, raw: bool = False
) -> DataFrame:
    """Flat telemetry; a JSON null counts as absent.

    A record without a time gets the time it came in. Absent fields get the reader's defaults, which
    scoring needs; ``raw`` leaves them null, for whatever must tell a report from none.
    """
    record = {
        name: F.col(f"record.{name}") for name in
        ("swarm_id", "battery_percent", "battery_voltage", "altitude_m", "velocity_ms", "temperature_c", "signal_dbm", "connected")
    }
    record["latitude"], record["longitude"] = F.col("record.position.lat"), F.col("record.position.lon")
    filled = {name: c if raw and name != "swarm_id" else F.coalesce(c, F.lit(READER_DEFAULTS[name])) for name, c in record.items()}
    idle = F.lit(None) if raw else F.array(*[F.lit(0.0)] * 4)
    return _good(parsed).select(
        *_passed_on(parsed, value),
        F.col("record.drone_id").alias("drone_id"),
        F.coalesce(micros("record.timestamp"), ingest_us(parsed, ingest_ts)).alias("us"),
        *[c.alias(n) for n, c in filled.items()],
        F.coalesce(F.col("record.motor_rpm"), idle).alias("motor_rpm"),
    ).withColumns({"timestamp_s": F.col("us") / F.lit(1e6), "ts": F.timestamp_micros("us")})


def decode_telemetry(
    df: DataFrame, value: str = "value", ingest_ts: str | None = None, raw: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Decoded telemetry and the quarantined rest: every record is in one of the two, and all decoded ones have a time."""
    parsed = parse(df, "telemetry", value, timed=ingest_us(df, ingest_ts))
    return telemetry_fields(parsed, value, ingest_ts, raw), quarantine(parsed, value)


def decode_inference(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Inference records; names default to ``unknown``, and ``model`` is read as ``model_name``."""
    parsed = parse(df, "inference", value, required=None)
    unknown = F.lit("unknown")
    good = _good(parsed).select(
        *_passed_on(parsed, value),
        F.coalesce("record.drone_id", unknown).alias("drone_id"),
        F.coalesce(micros("record.timestamp"), ingest_us(parsed)).alias("us"),
        F.coalesce("record.model_name", "record.model", unknown).alias("model_name"),
        F.coalesce("record.speed_mode", unknown).alias("speed_mode"),
        "record.latency_s", "record.fps",
        F.coalesce("record.detections", F.array().cast(TOPICS["inference"].schema["detections"].dataType)).alias("detections"),
    )
    return good, quarantine(parsed, value)


def decode_plain(df: DataFrame, topic: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Commands, battery events, alerts and scores: the schema's fields as they are."""
    parsed = parse(df, topic, value)
    good = _good(parsed).select(
        *_passed_on(parsed, value), *[F.col(f"record.{f.name}").alias(f.name) for f in TOPICS[topic].schema.fields]
    )
    if topic == "commands":
        good = good.withColumn("parameters", F.coalesce("parameters", F.create_map().cast("map<string,string>")))
    return good, quarantine(parsed, value)


def decode(df: DataFrame, topic: str, value: str = "value", raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """Decoded records of a topic and its rejects; ``raw`` telemetry has null where a field is absent."""
    if topic == "telemetry":
        return decode_telemetry(df, value, raw=raw)
    if topic == "inference":
        return decode_inference(df, value)
    return decode_plain(df, topic, value)


def detection_table(inference: DataFrame) -> DataFrame:
    """One row per box of decoded inference records.

    A box of fewer than four numbers has null corners; ``detections.malformed`` gives such boxes, and suppression
    and target choice leave them aside.
    """
    return inference.select(
        "drone_id", "us", "model_name", F.posexplode("detections").alias("det_idx", "d")
    ).select(
        "drone_id", "us", "model_name", F.col("det_idx").cast("bigint").alias("det_idx"),
        F.col("d.track_id").alias("track_id"), F.coalesce("d.class", F.lit("unknown")).alias("class_name"),
        F.col("d.confidence").alias("conf"),
        *[F.get("d.bbox", F.lit(i)).alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])],
    )
