"""Scans of file trees and log folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.operators.logs import pod_metadata


def below(root: str) -> Column:
    """The path of a scanned file without its scheme and the folder ``root``."""
    return F.substr(F.regexp_replace("path", r"^[a-z0-9]+:/{0,2}(?=/)", ""), F.lit(len(root.rstrip("/")) + 2))


def scan_files(spark: SparkSession, root: str, pattern: str | None = None, content: bool = False) -> DataFrame:
    """Every file below ``root``: path relative to it, length, time. Bytes are read only on request."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(
        below(root).alias("path"), "length", "modificationTime", *(["content"] if content else []),
    )


def scan_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Log lines with the metadata their file name carries."""
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").load(path)
    return pod_metadata(lines.select(F.col("value").alias("message"), F.col("_metadata.file_path").alias("file_path")))
