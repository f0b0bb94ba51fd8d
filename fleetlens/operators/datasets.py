"""Dataset files: statistics, hashes, versions, splits, pairing of images and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Split shares and class names left out of training.
SPLITS = {"train": 0.8, "val": 0.15, "test": 0.05}
IGNORED_CLASSES = ["others", "occluded"]
MB = 1024 * 1024


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for names without one, or with only a leading dot."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")
    )


def dataset_stats(files: DataFrame) -> DataFrame:
    """Files, size in MB, and a count per extension. Extensions are counted before they meet in one row."""
    return extension_counts(files).agg(
        F.sum("n_files").alias("total_files"),
        F.round(F.sum("bytes") / MB, 2).alias("total_size_mb"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n_files")))).alias("file_types"),
    )


def subdirectories(files: DataFrame) -> DataFrame:
    """Every directory that holds a file, at any depth. Empty directories cannot be seen."""
    parts = F.split(F.col("path"), "/")
    depth = F.size(parts) - 1
    parents = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.filter(depth > 0).select(F.explode(parents).alias("directory")).distinct()


def file_hashes(files: DataFrame) -> DataFrame:
    """MD5 of every file's content. Needs the ``content`` column of a binary scan."""
    return files.withColumn("md5", F.md5("content")).drop("content")


def dataset_version(files: DataFrame, fanout: int = 3) -> DataFrame:
    """One hash for a set of files, changed by any new, renamed or edited file.

    Files fall into ``16 ** fanout`` groups by the hash of their path, whatever directory they
    are in. Each group's sorted (path, hash) list is hashed, then the sorted group hashes.
    """
    group = F.substring(F.md5("path"), 1, fanout)
    entry = F.concat_ws(":", "path", "md5")
    groups = files.groupBy(group.alias("g")).agg(
        F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("h")
    )
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "g", "h")))
    return groups.agg(F.md5(F.array_join(listed, "\n")).alias("version"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed or changed between two manifests."""
    a, b = old.select("path", F.col("md5").alias("old_md5")), new.select("path", F.col("md5").alias("new_md5"))
    kind = (
        F.when(F.col("old_md5").isNull(), "added").when(F.col("new_md5").isNull(), "removed")
        .when(F.col("old_md5") != F.col("new_md5"), "changed")
    )
    return a.join(b, "path", "full_outer").withColumn("change", kind).filter("change is not null").select(
        "path", "change", "old_md5", "new_md5"
    )


def assign_split(df: DataFrame, key: str, shares: dict[str, float] = SPLITS) -> DataFrame:
    """A stable split per key, from its hash; a row's split does not depend on other rows."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 1000
    split, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        here = F.col("_bucket") < round(upto * 1000)
        split = F.when(here, name) if split is None else split.when(here, name)
    return df.withColumn("_bucket", bucket).withColumn("split", split).drop("_bucket")


def without_ignored(df: DataFrame, classes: Sequence[str] = IGNORED_CLASSES) -> DataFrame:
    return df.filter(~F.col("class_name").isin(list(classes)))


def image_label_files(files: DataFrame) -> DataFrame:
    """Images and label files of a ``split/images/*.jpg``, ``split/labels/*.txt`` tree."""
    return files.withColumns({
        "split": F.regexp_extract("path", r"([^/]+)/(images|labels)/[^/]+$", 1),
        "kind": F.when(F.col("path").rlike(r"/images/[^/]+\.jpg$"), "image")
        .when(F.col("path").rlike(r"/labels/[^/]+\.txt$"), "label"),
        "stem": F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1),
    }).filter("kind is not null")


def split_counts(listed: DataFrame) -> DataFrame:
    return listed.groupBy("split").agg(
        F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "label").alias("labels")
    )


def pair_labels(listed: DataFrame) -> DataFrame:
    """Each image with its label by stem; an unpaired file shows a null on the other side."""
    images = listed.filter("kind = 'image'").select("split", "stem", F.col("path").alias("image"))
    labels = listed.filter("kind = 'label'").select("split", "stem", F.col("path").alias("label"))
    return images.join(labels, ["split", "stem"], "full_outer")


def missing_labels(listed: DataFrame) -> DataFrame:
    images = listed.filter("kind = 'image'").select("split", "stem", "path")
    return images.join(listed.filter("kind = 'label'"), ["split", "stem"], "left_anti")
