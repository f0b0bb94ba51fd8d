"""Small tables: looked up without a shuffle, and as given."""

from pyspark.sql import functions as F

from fleetlens.operators import lookups, runs
from fleetlens.plans import rules


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_no_shuffle_on_ids_modes_or_metrics(spark):
    rows = spark.range(1000).select(F.col("id").alias("cls_id"), F.lit("FAST").alias("speed_mode"), F.when(F.col("id") % 2 == 0, "consumer_lag").otherwise("job_uptime").alias("metric"),
                                    F.lit("d").alias("drone_id"), F.col("id").alias("tick"), F.rand(1).alias("value"))
    assert shuffles(lookups.with_class_name(rows, lookups.class_table(spark))) == []
    assert shuffles(lookups.with_speed_config(rows, lookups.speed_table(spark))) == []
    found = shuffles(rules.evaluate_all(rows, list(rules.RULES.values()), ["drone_id"]))
    assert found and not any("metric" in line for line in found)


def test_the_table_passed_in_is_what_counts(spark):
    modes = lookups.speed_table(spark).withColumn("speed_mode", F.when(F.col("speed_mode") == "BALANCED", "MINE").otherwise(F.col("speed_mode")))
    rows = spark.createDataFrame([("MINE",), ("BALANCED",), ("FAST",), (None,)], "speed_mode string")
    got = {r.speed_mode: (r.config_mode, r.tile_rows) for r in lookups.with_speed_config(rows, modes).collect()}
    assert got == {"MINE": ("MINE", 2), "BALANCED": ("FAST", 1), "FAST": ("FAST", 1), None: ("FAST", 1)}


def test_texts_with_percentages(spark):
    row = spark.createDataFrame([(0.9111, "d", "{percentage}", "{value} {drone_id}")],
                                "value double, drone_id string, summary_template string, description_template string")
    out = rules.annotate(row, ["drone_id"]).first()
    assert (out.summary, out.description) == ("91.11%", "0.91 d")


def test_requests_apply_in_order(spark):
    versions = spark.createDataFrame([("m", v, "None") for v in (1, 2, 3)], "model_name string, version bigint, stage string")
    asked = [("m", 1, "Production", 1), ("m", 2, "Production", 2), ("m", 2, "Production", 3), ("m", 3, "Staging", 4), ("m", 1, "Production", 5)]
    requests = spark.createDataFrame(asked, "model_name string, version bigint, stage string, asked_at bigint")
    got = sorted((r.version, r.stage) for r in runs.promote(versions, requests).collect())
    assert got == [(1, "Production"), (2, "Archived"), (3, "Staging")]
    assert runs.production(runs.promote(versions, requests)).first().production_version == 1
