"""Container logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

INDEX_PREFIX = "fleet-logs-"
APP = "fleet"
FIELDS = "drone_id string, severity string, k bigint"


def pod_metadata(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Pod, namespace and container from a container log's path."""
    pattern = r"([^/_]+)_([^/_]+)_([^/]+)-[0-9a-f]+\.log$"
    return df.withColumns({
        "pod": F.regexp_extract(path, pattern, 1),
        "namespace": F.regexp_extract(path, pattern, 2),
        "container": F.regexp_extract(path, pattern, 3),
    })


def parse_json_logs(df: DataFrame, app: str = APP, fields: str = FIELDS) -> DataFrame:
    """Parse ``message`` for rows of ``app`` only; the others pass unchanged."""
    return df.withColumn("fields", F.when(F.col("app") == app, F.from_json("message", fields)))


def daily_index(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "log_date": F.to_date("ts"),
        "index_name": F.concat(F.lit(INDEX_PREFIX), F.date_format("ts", "yyyy.MM.dd")),
    })


def write_daily(df: DataFrame, path: str) -> None:
    """Append to a table with one partition per day, at most a few files per day and task."""
    daily_index(df).write.mode("append").partitionBy("log_date").parquet(path)


def search(df: DataFrame, drone_id: str | None = None, severity: str | None = None) -> DataFrame:
    if drone_id is not None:
        df = df.filter(F.col("fields.drone_id") == drone_id)
    if severity is not None:
        df = df.filter(F.col("fields.severity") == severity)
    return df
