"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "8", app: str = "fleetlens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.unix.domain.socket.enabled": "true",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="fleetlens-"),
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A table of rows given in the program. Spark knows its size, so that a join broadcasts it by its own check.

    A frame made of Python rows would count as unboundedly large.
    """
    names = [field.split()[0] for field in ddl.split(",")]
    table = pa.table({name: pa.array([row[i] for row in rows]) for i, name in enumerate(names)})
    return spark.createDataFrame(table).select(*[
        F.col(name).cast(kind).alias(name) for name, kind in (field.split() for field in ddl.split(","))])


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the library's results depend on: epoch arithmetic is done in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``, and so does :func:`local_session`. Only in
    another local session where that is unset is a temporary folder taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="fleetlens-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, for results that several later steps read.

    Evaluates ``df`` once, now. The table survives the loss of executors, and later steps read
    only the columns they need.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, through Hadoop's interface, so that any store will do."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder
