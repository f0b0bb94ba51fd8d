"""Alert rules over metric series: a rule table, and its evaluation with ``for`` durations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetlens.operators.series import SECOND, STEP_S, ceil_to, on_grid
from fleetlens.operators.windows import fixed_sum
from fleetlens.session import small_table


@dataclass(frozen=True)
class Rule:
    alert: str
    metric: str
    op: str
    threshold: float
    for_s: int
    severity: str
    team: str
    summary: str
    description: str = ""


# Limits, durations, severities, teams and the texts for drones. Names of metrics, and the
# names and texts of rules on the platform itself, are our own, without product names.
RULES = {r.alert: r for r in [
    Rule("DroneBatteryCritical", "drone_battery_percent", "<", 15.0, 30, "critical", "drone-ops",
         "Drone {drone_id} battery critically low",
         "Drone {drone_id} battery at {value}%. Immediate RTH (Return-To-Home) required."),
    Rule("DroneBatteryLow", "drone_battery_percent", "<", 30.0, 60, "warning", "drone-ops",
         "Drone {drone_id} battery low", "Drone {drone_id} battery at {value}%. Plan RTH."),
    Rule("DroneConnectionLost", "drone_connected", "==", 0.0, 15, "critical", "drone-ops",
         "Drone {drone_id} connection lost", "Lost telemetry from drone {drone_id}. Last seen {value}s ago."),
    Rule("DroneAltitudeExceeded", "drone_altitude_meters", ">", 120.0, 10, "warning", "drone-ops",
         "Drone {drone_id} altitude breach", "Drone at {value}m — exceeds 120m ceiling."),
    Rule("SwarmDroneCountLow", "connected_drones", "<", 3.0, 60, "warning", "drone-ops",
         "Swarm size critically low", "Only {value} drones connected. Minimum swarm size is 3."),
    Rule("InferenceLatencyHigh", "inference_latency_seconds", ">", 0.5, 120, "warning", "ml-ops",
         "Inference latency too high on drone {drone_id}", "Inference latency {value}s exceeds 500ms threshold."),
    Rule("DroneMotorAnomaly", "drone_motor_deviation", ">", 0.3, 30, "warning", "drone-ops",
         "Motor anomaly detected on drone {drone_id}", "Motor {motor_id} RPM deviates >30% from mean."),
    Rule("ConsumerLag", "consumer_lag", ">", 10_000.0, 300, "warning", "platform",
         "Consumer lag high", "Consumer group {group} lag is {value} messages."),
    Rule("JobRestarting", "job_restarts", ">", 2.0, 60, "critical", "platform",
         "Job restarting repeatedly", "Job {job_name} has restarted {value} times."),
    Rule("JobDown", "job_uptime", "==", 0.0, 30, "critical", "platform", "Job {job_name} is down"),
    Rule("CheckpointFailed", "checkpoint_failures_increase", ">", 0.0, 0, "warning", "platform",
         "Checkpoint failed", "Checkpoint failure detected for job {job_name}."),
    Rule("DiskUsageHigh", "disk_usage_ratio", ">", 0.85, 300, "warning", "platform",
         "Disk usage above 85%", "Storage usage at {percentage}."),
    Rule("DroneHealthScoreLow", "drone_health_score", "<", 50.0, 60, "warning", "drone-ops",
         "Drone {drone_id} health score low ({value})"),
]}

COMPARE = {
    "<": lambda value, limit: value < limit,
    ">": lambda value, limit: value > limit,
    "==": lambda value, limit: value == limit,
}


def with_state(true_ticks: DataFrame, labels: Sequence[str], for_s: int | Column, step_s: int = STEP_S) -> DataFrame:
    """Add ``since`` and ``state`` to the ticks at which a condition holds.

    A run of consecutive ticks is one alert. It is pending until the condition has held for
    ``for_s``, and firing from then on.
    """
    step = step_s * SECOND
    series = Window.partitionBy(*labels).orderBy("tick")
    run = F.col("tick") - F.row_number().over(series).cast("bigint") * F.lit(step)
    runs = true_ticks.withColumn("_run", run)
    since = F.min("tick").over(Window.partitionBy(*labels, "_run"))
    needed = (F.lit(for_s) if isinstance(for_s, int) else for_s).cast("bigint") * F.lit(SECOND)
    return (
        runs.withColumn("since", since)
        .withColumn("state", F.when(F.col("tick") - F.col("since") >= needed, "firing").otherwise("pending"))
        .drop("_run")
    )


def evaluate(grid: DataFrame, rule: Rule, labels: Sequence[str], step_s: int = STEP_S) -> DataFrame:
    """Active alerts of one rule over a grid of ``labels, tick, value``. Absent means inactive."""
    true_ticks = grid.filter(COMPARE[rule.op](F.col("value"), F.lit(rule.threshold)))
    return with_state(true_ticks.select(*labels, "tick", "value"), labels, rule.for_s, step_s)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return small_table(
        spark,
        [(r.alert, r.metric, r.op, r.threshold, r.for_s, r.severity, r.team, r.summary, r.description) for r in rules],
        "alert string, metric string, op string, threshold double, for_s bigint, severity string, team string, "
        "summary_template string, description_template string",
    )


def evaluate_all(
    grid: DataFrame, rules: Sequence[Rule], labels: Sequence[str], step_s: int = STEP_S
) -> DataFrame:
    """All threshold rules in one pass over ``metric, labels, tick, value``, with their texts."""
    table = rule_table(grid.sparkSession, rules)
    met = F.lit(False)
    for op, compare in COMPARE.items():
        met = met | ((F.col("op") == op) & compare(F.col("value"), F.col("threshold")))
    # Rows that meet none of their metric's rules go before they are repeated for each of them.
    any_met = F.lit(False)
    for r in rules:
        any_met = any_met | ((F.col("metric") == r.metric) & COMPARE[r.op](F.col("value"), F.lit(r.threshold)))
    active = grid.filter(any_met).join(table, "metric").filter(met)
    stated = with_state(active, ["alert", *labels], F.col("for_s"), step_s)
    return annotate(stated, labels)


def annotate(alerts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Fill ``{label}``, ``{value}`` and ``{percentage}`` of the text templates."""

    def fill(template: str) -> Column:
        text = F.col(template)
        for name in labels:
            text = F.replace(text, F.lit("{%s}" % name), F.coalesce(F.col(name), F.lit("")))
        text = F.replace(text, F.lit("{percentage}"), percentage("value"))
        return F.replace(text, F.lit("{value}"), F.round("value", 2).cast("string"))

    return alerts.withColumns({
        "summary": fill("summary_template"), "description": fill("description_template")
    }).drop("summary_template", "description_template")


def percentage(ratio: str | Column) -> Column:
    value = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.concat(F.round(value * 100, 2).cast("string"), F.lit("%"))


def connected_count(grid: DataFrame, step_s: int = STEP_S) -> DataFrame:
    """Connected drones of the whole fleet at every tick, 0 where no series has a value.

    One row per tick is left before anything is ordered.
    """
    counts = grid.groupBy("tick").agg(F.count_if(F.col("value") == 1).cast("double").alias("n"))
    span = counts.agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    ticks = span.select(F.explode(F.sequence("a", "b", F.lit(step_s * SECOND).cast("bigint"))).alias("tick"))
    return ticks.join(counts, "tick", "left").select(
        F.lit("fleet").alias("scope"), "tick", F.coalesce("n", F.lit(0.0)).alias("value")
    )


def motor_deviation(grid: DataFrame) -> DataFrame:
    """Relative distance of each motor from the mean of its drone's motors at the tick."""
    group = Window.partitionBy("drone_id", "swarm_id", "tick")
    mean = F.avg("value").over(group)
    return grid.withColumn("_mean", mean).select(
        "drone_id", "swarm_id", "motor_id", "tick",
        F.try_divide(F.abs(F.col("value") - F.col("_mean")), F.col("_mean")).alias("value"),
    )


def mean_series(df: DataFrame, labels: Sequence[str], value: str, every_s: int = STEP_S) -> DataFrame:
    """Mean of an observed value per interval, sampled at the interval's end."""
    at = (F.expr(f"us div {every_s * SECOND}") + 1) * F.lit(every_s * SECOND)
    return df.groupBy(*labels, at.alias("sample_us")).agg((fixed_sum(value).cast("double") / F.count(value)).alias("value"))


def stale_data(df: DataFrame, running: DataFrame, silent_s: int = 60, step_s: int = STEP_S) -> DataFrame:
    """Ticks at which a running drone has been silent for ``silent_s`` or more."""
    seen = (
        df.groupBy("drone_id", ceil_to("us", step_s).alias("_tick")).agg(F.max("us").alias("sample_us"))
        .join(running.select("drone_id").distinct(), "drone_id", "left_semi")
        .withColumn("value", F.col("sample_us").cast("double")).drop("_tick")
    )
    end = ceil_to(df.agg(F.max("us")).scalar(), step_s)
    grid = on_grid(seen, ["drone_id"], step_s, lookback_s=None, end_us=end)
    silent = F.col("tick") - F.col("sample_us")
    return grid.filter(silent >= silent_s * SECOND).select("drone_id", "tick", (silent / F.lit(1e6)).alias("silent_s"))


def confidence_drift(
    detections: DataFrame, size_s: int = 10, baseline_windows: int = 5, drop: float = 0.3
) -> DataFrame:
    """Fleet mean confidence per window against the mean of the windows before it."""
    size = size_s * SECOND
    means = detections.groupBy((F.expr(f"us div {size}") * size).alias("start_us")).agg(
        fixed_sum("conf", 6).alias("total"), F.count("conf").alias("n")
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("start_us").rowsBetween(-baseline_windows, -1)
    compared = means.select(
        "start_us", "n", (F.col("total").cast("double") / F.col("n")).alias("mean_confidence"),
        (F.sum("total").over(earlier).cast("double") / F.sum("n").over(earlier)).alias("baseline"),
    )
    ratio = F.try_divide("mean_confidence", "baseline")
    return compared.withColumn("ratio", ratio).withColumn("drifted", F.coalesce(ratio < 1 - drop, F.lit(False)))


def availability(df: DataFrame, step_s: int = STEP_S, target: float = 0.999) -> DataFrame:
    """Share of ticks before which a drone sent a record within one step."""
    heard = df.groupBy("drone_id", ceil_to("us", step_s).alias("tick")).agg(F.count(F.lit(1)).alias("_n"))
    span = df.agg(F.min(ceil_to("us", step_s)).alias("a"), F.max(ceil_to("us", step_s)).alias("b"))
    ticks = span.select(((F.col("b") - F.col("a")) / F.lit(step_s * SECOND) + 1).cast("bigint")).scalar()
    return heard.groupBy("drone_id").agg(F.count(F.lit(1)).alias("ticks_heard")).select(
        "drone_id", "ticks_heard", (F.col("ticks_heard") / ticks).alias("availability"),
        (F.col("ticks_heard") / ticks >= target).alias("met"),
    )
