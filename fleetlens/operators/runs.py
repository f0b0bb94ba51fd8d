"""Training runs: metrics and params in long form, run comparison, model stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Metric keys of an epoch by column.
EPOCH_KEYS = {
    "train_loss": "train/loss",
    "val_loss": "val/loss",
    "val_map50": "val/mAP50",
    "val_map50_95": "val/mAP50-95",
    "precision": "val/precision",
    "recall": "val/recall",
    "learning_rate": "train/lr",
}
PRODUCTION, ARCHIVED = "Production", "Archived"


def _long(df: DataFrame, ids: Sequence[str], pairs: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Key/value rows; null values are left out."""
    items = F.array(*[F.struct(k.alias("key"), v.cast("double").alias("value")) for k, v in pairs])
    return df.select(*ids, F.inline(items)).filter(F.col("value").isNotNull())


def epoch_metrics(df: DataFrame, custom: Sequence[str] = ()) -> DataFrame:
    """One row per metric and epoch; columns beyond the known ones get the prefix ``custom/``."""
    known = [(F.lit(key), F.col(c)) for c, key in EPOCH_KEYS.items() if c in df.columns]
    extra = [(F.lit(f"custom/{c}"), F.col(c)) for c in custom]
    return _long(df.withColumnRenamed("epoch", "step"), ["run_id", "step"], known + extra)


def flatten_params(df: DataFrame) -> DataFrame:
    """``params`` plus ``augmentation`` entries under ``aug_``, as rows."""
    augmented = F.transform_keys(F.coalesce("augmentation", F.create_map().cast("map<string,string>")),
                                 lambda k, _: F.concat(F.lit("aug_"), k))
    entries = F.concat(F.map_entries("params"), F.map_entries(augmented))
    return df.select("run_id", F.inline(entries)).toDF("run_id", "key", "value")


def final_metrics(df: DataFrame) -> DataFrame:
    """Best values and training time; the model size only where it is known and not zero."""
    size = F.when(F.col("model_size_mb") != 0, F.col("model_size_mb"))
    return _long(df, ["run_id"], [
        (F.lit("best/mAP50"), F.col("best_map50")),
        (F.lit("best/mAP50-95"), F.col("best_map50_95")),
        (F.lit("best/epoch"), F.col("best_epoch")),
        (F.lit("training_time_seconds"), F.col("training_time_s")),
        (F.lit("training_time_hours"), F.col("training_time_s") / F.lit(3600.0)),
        (F.lit("model_size_mb"), size),
    ])


def speed_metrics(df: DataFrame) -> DataFrame:
    def key(name: str) -> Column:
        return F.concat(F.lit("speed/"), F.col("mode"), F.lit(f"/{name}"))

    return _long(df, ["run_id"], [(key(n), F.col(n)) for n in ("fps", "latency_ms", "imgsz")])


def class_metrics(df: DataFrame) -> DataFrame:
    """``class/{class}/{metric}`` rows from a map of maps."""
    per_class = df.select("run_id", F.explode("class_metrics").alias("class_name", "metrics"))
    per_metric = per_class.select("run_id", "class_name", F.explode("metrics").alias("metric", "value"))
    return per_metric.select("run_id", F.concat_ws("/", F.lit("class"), "class_name", "metric").alias("key"), "value")


def dataset_info(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "total_images": F.col("train_images") + F.col("val_images") + F.col("test_images"),
        "num_classes": F.size("class_distribution").cast("bigint"),
    })


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Value of the last step per run and key; the larger value where a step was logged twice."""
    return metrics.groupBy("run_id", "key").agg(F.max(F.struct("step", "value")).alias("_m")).select(
        "run_id", "key", F.col("_m.value").alias("value")
    )


def compare_runs(
    runs: DataFrame, metrics: DataFrame, params: DataFrame, experiment: str, metric: str, n: int = 5
) -> DataFrame:
    """The ``n`` best runs of an experiment, with all their metrics and params as maps.

    The metric of the experiment's runs is ranked first; details are read for ``n`` runs only.
    """
    wanted = runs.filter(F.col("experiment") == experiment)
    ranked_by = latest_metrics(metrics.filter(F.col("key") == metric)).select("run_id", F.col("value").alias("_rank"))
    top = (
        wanted.join(ranked_by, "run_id", "left")
        .orderBy(F.desc_nulls_last("_rank"), "run_id").limit(n)
    )
    ids = F.broadcast(top.select("run_id"))  # at most n rows

    def as_map(rows: DataFrame, name: str) -> DataFrame:
        entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))
        return rows.groupBy("run_id").agg(entries.alias(name))

    chosen_metrics = as_map(latest_metrics(metrics.join(ids, "run_id", "left_semi")), "metrics")
    chosen_params = as_map(params.join(ids, "run_id", "left_semi"), "params")
    return (
        top.join(chosen_metrics, "run_id", "left").join(chosen_params, "run_id", "left")
        .orderBy(F.desc_nulls_last("_rank"), "run_id").withColumnRenamed("_rank", "value")
    )


def promote(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Stages after applying ``requests`` (model, version, stage, asked_at) in the order of ``asked_at``.

    A version's last request decides its stage. A request for Production archives every other version
    that is in Production then; so of a model's versions only the one asked for last, if its last
    request is that one, stays there. A rollback is a later request for an older version.
    """
    last = requests.groupBy("model_name", "version").agg(
        F.max_by("stage", "asked_at").alias("_asked"))
    latest = requests.filter(F.col("stage") == PRODUCTION).groupBy("model_name").agg(
        F.max_by("version", "asked_at").alias("_winner"))
    moved = versions.join(last, ["model_name", "version"], "left").join(latest, "model_name", "left")
    moved = moved.withColumn("stage", F.coalesce("_asked", "stage"))
    overtaken = (F.col("stage") == PRODUCTION) & F.col("_winner").isNotNull() & (F.col("version") != F.col("_winner"))
    return moved.withColumn("stage", F.when(overtaken, ARCHIVED).otherwise(F.col("stage"))).select(versions.columns)


def production(versions: DataFrame) -> DataFrame:
    """Current Production version per model, null where there is none."""
    current = F.max(F.when(F.col("stage") == PRODUCTION, F.col("version"))).alias("production_version")
    return versions.groupBy("model_name").agg(current).withColumn(
        "uri", F.when(F.col("production_version").isNotNull(), F.concat_ws("/", F.lit("models:"), "model_name", F.lit(PRODUCTION)))
    )
