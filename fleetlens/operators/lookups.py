"""Small dimension tables: class names, speed modes, command modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fleetlens.schemas import CLASS_NAMES, SPEED_MODES
from fleetlens.session import small_table

# Mission mode after a command. Any other command is unknown.
COMMAND_MODES = {
    "land": "emergency",
    "return_home": "return_home",
    "hover": "idle",
    "patrol": "patrol",
    "engage_target": "follow",
}


def class_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    return small_table(spark, list(enumerate(names or CLASS_NAMES)), "cls_id bigint, class_name string")


def with_class_name(df: DataFrame, classes: DataFrame, unknown: str | None = "unknown") -> DataFrame:
    """Add ``class_name``. Ids without a name get ``unknown``, or their own number when that is None.

    Spark broadcasts the table as long as its size is below the broadcast threshold.
    """
    default = F.col("cls_id").cast("string") if unknown is None else F.lit(unknown)
    return df.join(classes, "cls_id", "left").withColumn("class_name", F.coalesce("class_name", default))


def speed_table(spark: SparkSession) -> DataFrame:
    return small_table(
        spark, SPEED_MODES,
        "speed_mode string, imgsz bigint, tile_rows bigint, tile_cols bigint, overlap double, target_fps bigint",
    )


def with_speed_config(df: DataFrame, modes: DataFrame, default: str = "FAST") -> DataFrame:
    """Add the settings of each row's speed mode; modes that ``modes`` lacks get those of ``default``.

    Every mode of the table is known, and no other. The default's settings are scalar values.
    """
    settings = [c for c in modes.columns if c != "speed_mode"]
    fallback = modes.filter(F.col("speed_mode") == default)
    joined = df.join(modes.withColumnRenamed("speed_mode", "config_mode"), F.col("speed_mode") == F.col("config_mode"), "left")
    known = F.col("config_mode").isNotNull()
    filled = {c: F.when(known, F.col(c)).otherwise(fallback.select(c).scalar()) for c in settings}
    return joined.withColumns(filled).withColumn("config_mode", F.coalesce("config_mode", F.lit(default)))


def with_version(
    df: DataFrame, versions: DataFrame, key: str, fields: Sequence[str], at: str = "us", since: str = "valid_from", name: str = "config",
) -> DataFrame:
    """Add ``name``, the ``fields`` of the version of ``key`` that held at each row's time; null before the first one.

    ``versions`` has a row per key and change, with the time ``since`` which it holds; of two changes at one
    time the one with the larger fields counts. Its history is made into intervals, so a row meets one version and
    is not repeated. The table is broadcast where Spark knows that it is small; a hot key is then no matter.
    """
    distinct = versions.groupBy(F.col(key).alias("_key"), F.col(since).alias("_from")).agg(F.max(F.struct(*fields)).alias("_version"))
    until = F.lead("_from").over(Window.partitionBy("_key").orderBy("_from"))
    held = distinct.filter(F.col("_from").isNotNull()).withColumn("_until", until)
    valid = F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return df.join(held, valid, "left").select(*df.columns, F.col("_version").alias(name))


def insert_if_absent(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``existing`` plus the rows of ``wanted`` whose key it lacks."""
    new = wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new)
