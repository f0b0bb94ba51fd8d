"""Event-time windows over scored telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.columns import earliest, latest, seconds
from fleetlens.operators.anomalies import with_deltas
from fleetlens.operators.ordered import DEFAULT_SLICE_US, rolling_lag

WATERMARK = "5 seconds"


def fixed_sum(name: str, digits: int = 8) -> Column:
    """Sum in fixed point, so that the order of tasks cannot change it."""
    return F.sum(F.col(name).cast(f"decimal(18,{digits})"))


def exact_avg(name: str, digits: int = 4) -> Column:
    return fixed_sum(name, digits).cast("double") / F.count(name)


def tumbling(scored: DataFrame, size_s: int = 10) -> DataFrame:
    """Health per drone and window. Works on batch frames and on streams with a watermark on ``ts``."""
    return (
        scored.groupBy("drone_id", F.window("ts", f"{size_s} seconds"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            exact_avg("overall_score").alias("avg_score"),
            F.min("overall_score").alias("min_score"),
            F.max("overall_score").alias("max_score"),
            exact_avg("battery_health").alias("avg_battery_health"),
            exact_avg("motor_health").alias("avg_motor_health"),
            exact_avg("signal_health").alias("avg_signal_health"),
            exact_avg("thermal_health").alias("avg_thermal_health"),
            F.sum(F.size("anomaly_flags")).alias("n_anomalies"),
        )
        .select("drone_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "n", "avg_score", "min_score", "max_score", "avg_battery_health", "avg_motor_health",
                "avg_signal_health", "avg_thermal_health", "n_anomalies")
    )


def _slope(n: str, x: str, xx: str, y: str, xy: str) -> Column:
    """Least-squares slope from sums; null where the x values do not differ."""
    spread = F.col(n) * F.col(xx) - F.col(x) * F.col(x)
    return F.when(F.col(n) > 1, F.try_divide(F.col(n) * F.col(xy) - F.col(x) * F.col(y), spread))


def sliding(df: DataFrame, size_s: int = 60, slide_s: int = 10) -> DataFrame:
    """Trends per drone and sliding window: slopes of temperature and battery, per second.

    Records are first summed into panes one slide long; only panes are copied into the windows
    that cover them, so a row is never multiplied by ``size / slide``.
    """
    size, slide = size_s * 1_000_000, slide_s * 1_000_000
    pane = F.expr(f"us div {slide} * {slide}")
    x = seconds(F.col("us") - pane)
    panes = df.groupBy("drone_id", pane.alias("pane")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("x"),
        F.sum(x * x).alias("xx"),
        fixed_sum("temperature_c").alias("temp"),
        F.sum(x * F.col("temperature_c")).alias("x_temp"),
        fixed_sum("battery_percent").alias("batt"),
        F.sum(x * F.col("battery_percent")).alias("x_batt"),
        latest("battery_percent", "us", "event_id").alias("last_batt"),
    )
    starts = F.sequence(F.col("pane") - F.lit(size - slide), F.col("pane"), F.lit(slide).cast("bigint"))
    placed = panes.withColumn("start_us", F.explode(starts)).withColumn("o", seconds(F.col("pane") - F.col("start_us")))
    n, o = F.col("n"), F.col("o")
    sums = placed.groupBy("drone_id", "start_us").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("x") + n * o).alias("x"),
        F.sum(F.col("xx") + F.lit(2.0) * o * F.col("x") + n * o * o).alias("xx"),
        F.sum("temp").alias("temp"),
        F.sum(F.col("x_temp") + o * F.col("temp").cast("double")).alias("x_temp"),
        F.sum("batt").alias("batt"),
        F.sum(F.col("x_batt") + o * F.col("batt").cast("double")).alias("x_batt"),
        F.max_by("last_batt", "pane").alias("last_batt"),
    )
    sums = sums.withColumns({"temp": F.col("temp").cast("double"), "batt": F.col("batt").cast("double")})
    return sums.select(
        "drone_id", "start_us", (F.col("start_us") + F.lit(size)).alias("end_us"), "n",
        (F.col("temp") / n).alias("avg_temperature"),
        (F.col("batt") / n).alias("avg_battery"),
        _slope("n", "x", "xx", "temp", "x_temp").alias("temperature_slope"),
        _slope("n", "x", "xx", "batt", "x_batt").alias("battery_slope"),
        F.col("last_batt").alias("last_battery"),
    )


def sliding_stream(df: DataFrame, size_s: int = 60, slide_s: int = 10) -> DataFrame:
    """The streaming form of :func:`sliding`: one windowed aggregation under a watermark."""
    t = F.col("us").cast("double") / F.lit(1e6)
    return (
        df.groupBy("drone_id", F.window("ts", f"{size_s} seconds", f"{slide_s} seconds"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("temperature_c").alias("avg_temperature"),
            F.avg("battery_percent").alias("avg_battery"),
            F.regr_slope("temperature_c", t).alias("temperature_slope"),
            F.regr_slope("battery_percent", t).alias("battery_slope"),
        )
        .select("drone_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "n", "avg_temperature", "avg_battery", "temperature_slope", "battery_slope")
    )


def battery_prediction(trends: DataFrame) -> DataFrame:
    """Seconds until empty, from the window's drain; null when the battery is not draining."""
    drain = -F.col("battery_slope")
    return trends.select(
        "drone_id", "start_us", "last_battery",
        F.when(drain > 0, drain).alias("drain_per_s"),
        F.when(drain > 0, F.col("last_battery") / drain).alias("seconds_to_empty"),
    )


def sessions(df: DataFrame, gap_s: int = 300, width_us: int = DEFAULT_SLICE_US) -> DataFrame:
    """Mission segments: a drone's records until nothing arrives for more than ``gap_s``.

    Records of one cell of ``gap_s`` always share a session, so they are summed up first. What
    is ordered per drone is its cells, and there are never more of them than ``span / gap_s``.
    """
    gap = gap_s * 1_000_000
    hops = with_deltas(df, ttl_s=max(600, gap_s + 1), width_us=width_us)
    same_session = F.col("us") - F.col("prev.us") <= gap
    cells = hops.groupBy("drone_id", F.expr(f"us div {gap}").alias("cell")).agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("n"),
        F.max("altitude_m").alias("max_altitude"),
        earliest("battery_percent", "us", "event_id").alias("first_batt"),
        latest("battery_percent", "us", "event_id").alias("last_batt"),
        F.sum(F.when(same_session, F.col("hop_m")).otherwise(0.0)).alias("distance_m"),
    )
    by_cell = Window.partitionBy("drone_id").orderBy("cell")
    opens = F.coalesce(F.col("first_us") - F.lag("last_us").over(by_cell) > gap, F.lit(True))
    numbered = cells.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(by_cell))
    return numbered.groupBy("drone_id", "session").agg(
        F.min("first_us").alias("start_us"),
        F.max("last_us").alias("end_us"),
        F.sum("n").alias("n"),
        F.max("max_altitude").alias("max_altitude"),
        (F.min_by("first_batt", "cell") - F.max_by("last_batt", "cell")).alias("battery_used"),
        F.sum("distance_m").alias("distance_m"),
    ).withColumn("duration_s", seconds(F.col("end_us") - F.col("start_us")))


def sessions_stream(df: DataFrame, gap_s: int = 300) -> DataFrame:
    """Sessions on a stream of scored records, whose ``prev`` and ``hop_m`` come from the stateful step.

    Of records without them the distance is null.
    """
    followed = {"prev", "hop_m"} <= set(df.columns)
    same_session = F.col("us") - F.col("prev.us") <= gap_s * 1_000_000 if followed else F.lit(False)
    hop = F.when(same_session, F.col("hop_m")).otherwise(0.0) if followed else F.lit(None).cast("double")
    return (
        df.withColumn("_hop", hop).groupBy("drone_id", F.session_window("ts", f"{gap_s} seconds"))
        .agg(
            F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"),
            F.max("altitude_m").alias("max_altitude"),
            (earliest("battery_percent", "us", "event_id") - latest("battery_percent", "us", "event_id")).alias("battery_used"),
            F.sum("_hop").alias("distance_m"),
        )
        .select("drone_id", "start_us", "end_us", "n", "max_altitude", "battery_used", "distance_m",
                seconds(F.col("end_us") - F.col("start_us")).alias("duration_s"))
    )


def rolling_rate(df: DataFrame, frames: int = 30, tie: str = "event_id", width_us: int = DEFAULT_SLICE_US) -> DataFrame:
    """Frame rate over the last ``frames`` gaps. The gaps add up to one difference of times."""
    rows = rolling_lag(df, ["drone_id"], "us", tie, "us", frames, "_since", "_pos", width_us)
    gaps = F.least(F.col("_pos") - 1, F.lit(frames))
    rate = F.try_divide(gaps.cast("double"), seconds(F.col("us") - F.col("_since")))
    return rows.withColumn("fps", F.when(gaps > 0, rate).otherwise(0.0)).drop("_since", "_pos")


def recent_events(df: DataFrame, text: str, *ties: str, n: int = 20) -> DataFrame:
    """The last ``n`` events of the fleet, with a clock prefix."""
    return (
        df.orderBy(F.desc("us"), *[F.desc(t) for t in ties]).limit(n)
        .withColumn("line", F.concat(F.date_format(F.timestamp_micros(F.col("us")), "'['HH:mm:ss'] '"), F.col(text)))
    )


def recent_per_key(df: DataFrame, keys: list[str], *order: str, n: int = 30) -> DataFrame:
    """The last ``n`` rows per key. Spark cuts each map task down to ``n`` per key before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)
