"""Dataset versions as trees of hashes: only what has changed is read, hashed and compared.

Files stand in the tree by the hash of their path. A leaf holds the files that share the first hex digits of it
and is the hash of their paths and contents; a node is the hash of its up to sixteen children, and the root is
the version. A version is stored as its files, partitioned by leaf, and its nodes. Two versions are compared from the
nodes, and only the leaves that differ are read. A new version takes over the hashes of all files whose
length and time are as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators.datasets import version_diff
from fleetlens.sources.files import below, scan_files

#: Files of a leaf, about.
LEAF_FILES = 50_000
#: Changed files that are read by name; beyond, their folder is scanned.
NAMED = 10_000
MANIFEST = "path string, length bigint, modified_us bigint, md5 string"


def levels_for(n_files: int, leaf_files: int = LEAF_FILES) -> int:
    """Levels below the root, so that a leaf has about ``leaf_files``."""
    return max(1, math.ceil(math.log(max(n_files, 1) / leaf_files, 16))) if n_files > leaf_files else 1


def tree(manifest: DataFrame, levels: int) -> DataFrame:
    """``(level, prefix, hash, n)`` of all nodes of a table of ``path, md5``; the root has level 0 and no prefix.

    A leaf's files are hashed together, a node's sixteen children are; nothing larger is ever in one place.
    """
    entry = F.concat_ws(":", "path", "md5")
    nodes = manifest.groupBy(F.substring(F.md5("path"), 1, levels).alias("prefix")).agg(
        F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("hash"), F.count(F.lit(1)).alias("n"))
    out = nodes.withColumn("level", F.lit(levels))
    for level in range(levels - 1, -1, -1):
        child = F.concat_ws(":", "prefix", "hash")
        nodes = nodes.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(
            F.md5(F.array_join(F.array_sort(F.collect_list(child)), "\n")).alias("hash"), F.sum("n").alias("n"))
        out = out.unionByName(nodes.withColumn("level", F.lit(level)))
    return out.select("level", "prefix", "hash", "n")


def save_version(manifest: DataFrame, target: str, levels: int | None = None) -> str:
    """Store a version, a table of ``path, length, modified_us, md5``, below ``target``; returns its hash."""
    spark = manifest.sparkSession
    manifest.withColumn("leaf", F.substring(F.md5("path"), 1, 8)).write.parquet(f"{target}/unsorted")
    stored = spark.read.parquet(f"{target}/unsorted")
    depth = levels or levels_for(stored.count())
    by_leaf = stored.withColumn("leaf", F.substring("leaf", 1, depth))
    by_leaf.repartition("leaf").write.partitionBy("leaf").parquet(f"{target}/files")
    tree(read_files(spark, target), depth).coalesce(1).write.parquet(f"{target}/nodes")
    return version(spark, target)


def read_files(spark: SparkSession, target: str) -> DataFrame:
    """The files of a stored version, with ``leaf``."""
    return spark.read.schema(f"{MANIFEST}, leaf string").parquet(f"{target}/files")


def read_nodes(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("level int, prefix string, hash string, n bigint").parquet(f"{target}/nodes")


def version(spark: SparkSession, target: str) -> str | None:
    """The hash of a stored version; None of one without files."""
    root = read_nodes(spark, target).filter("level = 0").first()
    return root["hash"] if root else None


def changed_leaves(spark: SparkSession, old: str, new: str) -> tuple[int, list[str]]:
    """The deepest level both versions have, and the prefixes there whose files differ. Their number is bounded by
    the tree's width."""
    a, b = (read_nodes(spark, t) for t in (old, new))
    depth = min(t.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for t in (a, b))
    if depth == 0:
        return 0, [""]
    # Subtrees that agree are left out level by level, so what is compared shrinks with what has changed.
    prefixes = [""]
    for level in range(1, depth + 1):
        under = F.substring("prefix", 1, level - 1).isin(prefixes)
        x, y = (t.filter((F.col("level") == level) & under).select("prefix", F.col("hash").alias(h)) for t, h in ((a, "x"), (b, "y")))
        differ = x.join(y, "prefix", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
        prefixes = [r["prefix"] for r in differ.select("prefix").collect()]
        if not prefixes:
            break
    return depth, prefixes


def diff(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Files added, removed or changed between two stored versions. Only the leaves that differ are read."""
    depth, prefixes = changed_leaves(spark, old, new)
    some = F.substring("leaf", 1, depth).isin(prefixes) if depth else F.lit(True)
    return version_diff(read_files(spark, old).filter(some), read_files(spark, new).filter(some))


def refreshed(spark: SparkSession, root: str, old: str | None, named: int = NAMED) -> DataFrame:
    """The manifest of a folder now. Files that ``old``, a stored version, has with the same length and time keep
    their hash; the content of all others, and of no more, is read."""
    now = scan_files(spark, root).select("path", "length", F.unix_micros("modificationTime").alias("modified_us"))
    if old is None:
        before = spark.createDataFrame([], MANIFEST)
    else:
        before = read_files(spark, old).drop("leaf")
    kept = now.join(before, ["path", "length", "modified_us"], "left")
    same, unknown = kept.filter(F.col("md5").isNotNull()), kept.filter(F.col("md5").isNull()).drop("md5")
    some = [r["path"] for r in unknown.select("path").limit(named + 1).collect()]
    if not some:
        return same.select("path", "length", "modified_us", "md5")
    if len(some) <= named:
        read = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{path}" for path in some]).withColumn("path", below(root))
    else:  # so many that a scan of all is the better way
        read = scan_files(spark, root, content=True)
    hashed = read.select("path", F.md5("content").alias("md5")).join(unknown, "path")
    return same.unionByName(hashed.select(same.columns)).select("path", "length", "modified_us", "md5")
