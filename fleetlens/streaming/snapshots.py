"""Current values under a stream: batches folded into snapshots, so that reading the newest state stays cheap.

A streaming job writes, batch by batch, the rows of the keys it heard of (``changes/batch_id=N``). Every so many
batches the newest snapshot and the batches since are folded into the next one (``snapshots/upto=N``), a row per key,
in files by key bucket. Readers take the newest finished snapshot and the batches after it: files bounded
by the keys and the folding interval, however long the stream has run. A batch that is repeated after a failure
writes the same folders again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fleetlens.functions.columns import order_key
from fleetlens.session import hadoop_folder

FOLD_EVERY, BUCKETS = 20, 16


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished ``name=N`` folders below a path, ascending."""
    files, folder = hadoop_folder(spark, path)
    if not files.exists(folder):
        return []
    found = [re.fullmatch(rf"{name}=(\d+)", status.getPath().getName()) for status in files.listStatus(folder)]
    numbers = [int(m[1]) for m in found if m]
    return sorted(n for n in numbers if files.exists(hadoop_folder(spark, f"{path}/{name}={n}/_SUCCESS")[1]))


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: str = "batch_id") -> DataFrame:
    """The row of each key with the largest ``order``; per column its last non-null value."""
    names = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in names], F.max(order).alias(order))


def _changes(spark: SparkSession, target: str, batches: Sequence[int]) -> DataFrame | None:
    paths = [f"{target}/changes/batch_id={n}" for n in batches]
    return spark.read.option("basePath", f"{target}/changes").parquet(*paths).withColumn("batch_id", F.col("batch_id").cast("bigint")) if paths else None


def current(
    spark: SparkSession, target: str, keys: Sequence[str], upto: int | None = None, keep_s: float | None = None, at: str = "us",
    order: str = "batch_id",
) -> DataFrame:
    """The newest row of every key, with ``batch_id``, from finished batches only.

    ``upto`` names the last batch to count. Newest is what the last batch wrote, or what has the largest ``order``. With ``keep_s``, keys whose time ``at`` lies further behind the newest
    key's are left out.
    """
    snapshots = [n for n in _numbered(spark, f"{target}/snapshots", "upto") if upto is None or n <= upto]
    base = snapshots[-1] if snapshots else -1
    later = _changes(spark, target, [n for n in _numbered(spark, f"{target}/changes", "batch_id") if n > base and (upto is None or n <= upto)])
    parts = [spark.read.parquet(f"{target}/snapshots/upto={base}").drop("bucket")] if snapshots else []
    parts += [later] if later is not None else []
    if not parts:
        raise FileNotFoundError(f"no finished batch below {target}")
    rows = newest_per_key(parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) == 2 else parts[0], keys, order)
    if keep_s is None:
        return rows
    return rows.filter(F.col(at) >= rows.agg(F.max(at)).scalar() - int(keep_s * 1_000_000))


def fold(
    spark: SparkSession, target: str, keys: Sequence[str], upto: int, keep_s: float | None = None, at: str = "us", order: str = "batch_id",
    buckets: int = BUCKETS,
) -> None:
    """Write the snapshot of all batches up to ``upto``, and drop what the snapshot before it has made needless.

    What the last snapshot is made from stays until the next one, in case this batch is repeated.
    """
    rows = current(spark, target, keys, upto, keep_s, at, order)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/snapshots/upto={upto}")
    before = [n for n in _numbered(spark, f"{target}/snapshots", "upto") if n < upto]
    if before:
        for path, name, numbers in (("snapshots", "upto", before[:-1]), ("changes", "batch_id", [
                n for n in _numbered(spark, f"{target}/changes", "batch_id") if n <= before[-1]])):
            for n in numbers:
                files, folder = hadoop_folder(spark, f"{target}/{path}/{name}={n}")
                files.delete(folder, True)


def keeping_current(
    target: str, keys: Sequence[str], every: int = FOLD_EVERY, keep_s: float | None = None, at: str = "us", order: str = "batch_id",
    of: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: write a batch's rows (or what ``of`` makes of them) and fold every ``every`` batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = of(batch) if of else batch
        rows.write.mode("overwrite").parquet(f"{target}/changes/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            fold(batch.sparkSession, target, keys, batch_id, keep_s, at, order)

    return write


def read_files(df: DataFrame) -> int:
    """How many files a table is read from."""
    return len(df.inputFiles())


def last_rows(batch: DataFrame, keys: Sequence[str], at: str = "us", tie: str = "event_id") -> DataFrame:
    """A batch's last row per key, with its place in time as ``place``; for streams without a state of their own."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return batch.withColumn("place", order_key(at, tie)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
