"""Metric series: sampling, the evaluation grid, counter increases, joins of series.

A series is a metric and its labels. Raw records are reduced to one sample per scrape interval
by a partial aggregation first, so that what is ordered per series is bounded by time
(``span / interval``) and not by how many records a drone sends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.columns import latest
from fleetlens.operators.fleet import ACTIVE_S, GAUGES

SCRAPE_S, STEP_S, LOOKBACK_S = 5, 15, 300
SECOND = 1_000_000


def floor_to(at: str | Column, size_s: int) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.floor(at / F.lit(size_s * SECOND)).cast("bigint") * F.lit(size_s * SECOND)


def ceil_to(at: str | Column, size_s: int) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    size = size_s * SECOND
    return at + F.pmod(-at, F.lit(size))


def scrape(df: DataFrame, fields: Sequence[str], every_s: int = SCRAPE_S, tie: str = "event_id") -> DataFrame:
    """Value of every field at each scrape: the last one reported during the interval before it.

    Wide aggregation first, rows second: the input is not multiplied by the number of fields.
    """
    wide = df.groupBy("drone_id", "swarm_id", (floor_to("us", every_s) + every_s * SECOND).alias("sample_us")).agg(
        *[latest(F.col(f).cast("double"), "us", tie, where=F.col(f).isNotNull()).alias(GAUGES.get(f, f)) for f in fields]
    )
    names = [GAUGES.get(f, f) for f in fields]
    return wide.unpivot(["drone_id", "swarm_id", "sample_us"], names, "metric", "value").filter("value is not null")


def scrape_motors(df: DataFrame, every_s: int = SCRAPE_S, tie: str = "event_id") -> DataFrame:
    motors = df.select(
        "drone_id", "swarm_id", "us", tie, F.posexplode("motor_rpm").alias("motor", "rpm")
    ).filter("rpm is not null")
    at = (floor_to("us", every_s) + every_s * SECOND).alias("sample_us")
    return motors.groupBy("drone_id", "swarm_id", "motor", at).agg(latest("rpm", "us", tie).alias("value")).select(
        "drone_id", "swarm_id", F.concat(F.lit("motor_"), F.col("motor").cast("string")).alias("motor_id"),
        "sample_us", "value",
    )


def connected_samples(df: DataFrame, stale_s: int = ACTIVE_S, every_s: int = SCRAPE_S) -> DataFrame:
    """Scraped connection gauge, with a 0 at the first scrape after ``stale_s`` without a record."""
    end = ceil_to(df.agg(F.max("us")).scalar(), every_s)
    samples = scrape(df, ["connected"], every_s).drop("metric")
    series = Window.partitionBy("drone_id", "swarm_id").orderBy("sample_us")
    lost_at = F.col("sample_us") + stale_s * SECOND
    until = F.coalesce(F.lead("sample_us").over(series), end + every_s * SECOND)
    here = F.struct("sample_us", "value")
    lost = F.struct(lost_at.alias("sample_us"), F.lit(0.0).alias("value"))
    return (
        samples.withColumn("until", until)
        .select("drone_id", "swarm_id", F.inline(
            F.when(lost_at < F.col("until"), F.array(here, lost)).otherwise(F.array(here))
        ))
    )


def grid_end(df: DataFrame, every_s: int = SCRAPE_S, step_s: int = STEP_S) -> Column:
    """Last tick for series scraped from ``df``, from one pass over its times and no shuffle."""
    newest = floor_to(F.max("us"), every_s) + every_s * SECOND
    return df.agg(ceil_to(newest, step_s).alias("end")).scalar()


def on_grid(
    samples: DataFrame, labels: Sequence[str], step_s: int = STEP_S, lookback_s: int | None = LOOKBACK_S,
    end_us: int | Column | None = None,
) -> DataFrame:
    """Value of every series at every tick: its last sample at or before the tick.

    A sample counts for less than ``lookback_s`` (None: until the next one). A sample is
    copied to the ticks it holds for; no series meets the whole grid. Give ``end_us`` where it is
    known more cheaply than from the samples, as by :func:`grid_end`.
    """
    step = step_s * SECOND
    end = ceil_to(samples.agg(F.max("sample_us")).scalar(), step_s) if end_us is None else end_us
    end = F.lit(end) if isinstance(end, int) else end
    per_tick = samples.groupBy(*labels, ceil_to("sample_us", step_s).alias("tick")).agg(
        F.max_by("value", "sample_us").alias("value"), F.max("sample_us").alias("sample_us")
    )
    series = Window.partitionBy(*labels).orderBy("tick")
    last = F.least(F.coalesce(F.lead("tick").over(series) - step, end), end)
    if lookback_s is not None:
        last = F.least(last, floor_to(F.col("sample_us") + lookback_s * SECOND - 1, step_s))
    held = per_tick.withColumn("_last", last).filter(F.col("_last") >= F.col("tick"))
    ticks = F.explode(F.sequence("tick", "_last", F.lit(step).cast("bigint")))
    return held.select(*labels, "value", "sample_us", ticks.alias("tick"))


def increase(samples: DataFrame, labels: Sequence[str], range_s: int = LOOKBACK_S) -> DataFrame:
    """Growth of a counter over the last ``range_s``, restarts from zero included."""
    series = Window.partitionBy(*labels).orderBy("sample_us")
    before = F.lag("value").over(series)
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    within = series.rangeBetween(-range_s * SECOND, 0)
    return samples.withColumn("_step", step).withColumn("increase", F.sum("_step").over(within)).drop("_step")


def combine(left: DataFrame, right: DataFrame, labels: Sequence[str], op: str) -> DataFrame:
    """``left op right`` where both series have a value at a tick; op is ``ratio`` or ``difference``."""
    a, b = left.select(*labels, "tick", F.col("value").alias("_a")), right.select(*labels, "tick", F.col("value").alias("_b"))
    value = F.try_divide("_a", "_b") if op == "ratio" else F.col("_a") - F.col("_b")
    return a.join(b, [*labels, "tick"]).select(*labels, "tick", value.alias("value")).filter("value is not null")


def as_labels(series: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The generic form of a series table: metric, a map of labels, time, value."""
    entries = [x for name in labels for x in (F.lit(name), F.col(name))]
    return series.select("metric", F.create_map(*entries).alias("labels"),
                         F.timestamp_micros("sample_us").alias("ts"), "value")


def retain(df: DataFrame, retention_s: int, as_of_us: int | Column | None = None) -> DataFrame:
    """Rows no older than ``retention_s`` before ``as_of_us`` (default: the newest row)."""
    as_of = df.agg(F.max("us")).scalar() if as_of_us is None else as_of_us
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    return df.filter(F.col("us") >= as_of - F.lit(retention_s * SECOND))
