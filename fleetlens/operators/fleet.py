"""Fleet metrics: latest values, histograms, counters and swarm state."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.columns import latest
from fleetlens.functions.health import fleet_member_score

# Gauge names by telemetry field.
GAUGES = {
    "battery_percent": "drone_battery_percent",
    "battery_voltage": "drone_voltage",
    "altitude_m": "drone_altitude_meters",
    "velocity_ms": "drone_velocity_ms",
    "connected": "drone_connected",
    "temperature_c": "drone_temperature_celsius",
    "signal_dbm": "drone_signal_strength_dbm",
    "latitude": "drone_latitude",
    "longitude": "drone_longitude",
}

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = [0.01, 0.025, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0]

ACTIVE_S = 30

#: Bands per unit of the natural logarithm, level by level, of exact quantiles.
BAND_SCALES = (1e3, 1e7, 1e12)


def gauges_wide(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """Latest non-null value of every field per drone and swarm; one partial aggregation."""
    fields = [
        latest(F.col(f).cast("double"), "us", tie, where=F.col(f).isNotNull()).alias(name)
        for f, name in GAUGES.items()
    ]
    return df.groupBy("drone_id", "swarm_id").agg(*fields)


def gauges(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """:func:`gauges_wide` as rows of metric, labels and value."""
    return (
        gauges_wide(df, tie).unpivot(["drone_id", "swarm_id"], list(GAUGES.values()), "metric", "value")
        .filter(F.col("value").isNotNull())
    )


def motor_gauges(df: DataFrame, tie: str = "event_id") -> DataFrame:
    motors = df.select("drone_id", "swarm_id", "us", tie, F.posexplode("motor_rpm").alias("motor", "rpm"))
    return (
        motors.filter(F.col("rpm").isNotNull()).groupBy("drone_id", "swarm_id", "motor")
        .agg(latest("rpm", "us", tie).alias("value"))
        .select("drone_id", "swarm_id", F.concat(F.lit("motor_"), F.col("motor").cast("string")).alias("motor_id"), "value")
    )


def latency_histogram(df: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts, with sum and count, per drone, model and mode."""
    keys = ["drone_id", "model_name", "speed_mode"]
    counted = df.filter(F.col("latency_s").isNotNull()).groupBy(*keys).agg(
        *[F.count_if(F.col("latency_s") <= b).alias(f"_{i}") for i, b in enumerate(bounds)],
        F.sum("latency_s").alias("latency_sum"),
        F.count("latency_s").alias("latency_count"),
    )
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("latency_count").alias("n")))
    return counted.select(*keys, "latency_sum", "latency_count", F.inline(F.array(*buckets)))


def latest_fps(df: DataFrame, tie: str) -> DataFrame:
    return df.filter(F.col("fps").isNotNull()).groupBy("drone_id", "model_name").agg(
        latest("fps", "us", tie).alias("fps")
    )


def detection_counts(inference: DataFrame) -> DataFrame:
    """Detections per drone and class, from records with a nested array."""
    return (
        inference.select("drone_id", F.explode("detections").alias("d"))
        .groupBy("drone_id", F.coalesce(F.col("d.class"), F.lit("unknown")).alias("class_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def last_records(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """Each drone's last whole record; a field missing there stays null."""
    fields = ["swarm_id", "battery_percent", "signal_dbm", "temperature_c", "altitude_m", "connected"]
    return df.groupBy("drone_id").agg(
        *[latest(f, "us", tie).alias(f) for f in fields], F.max("us").alias("last_seen_us")
    )


def _swarms(state: DataFrame) -> DataFrame:
    """Active drones and mean health of them per swarm, from rows with ``active``."""
    scored = state.withColumn("member_score", fleet_member_score("battery_percent", "signal_dbm", "temperature_c"))
    return scored.groupBy(F.coalesce("swarm_id", F.lit("default")).alias("swarm_id")).agg(
        F.count_if("active").alias("active_drones"),
        F.round(F.avg(F.when(F.col("active"), F.col("member_score"))), 3).alias("health_score"),
    )


def swarm_of(last: DataFrame, as_of_us: int | Column | None = None, active_s: float = ACTIVE_S) -> DataFrame:
    """:func:`swarm_status` of last records that are at hand, as a stream keeps them."""
    as_of = last.agg(F.max("last_seen_us")).scalar() if as_of_us is None else as_of_us
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    return _swarms(last.withColumn("active", as_of - F.col("last_seen_us") < F.lit(int(active_s * 1e6))))


def inference_totals(inference: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS, tie: str = "event_id") -> DataFrame:
    """Per drone, model and mode in one aggregation: histogram counts, sum, count, latest rate and detections."""
    sized = inference.withColumn("_n", F.size("detections"))
    return sized.groupBy("drone_id", "model_name", "speed_mode").agg(
        *[F.count_if(F.col("latency_s") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
        F.sum("latency_s").alias("latency_sum"), F.count("latency_s").alias("latency_count"),
        latest("fps", "us", tie, where=F.col("fps").isNotNull()).alias("fps"), F.sum("_n").alias("detections"),
    )


def with_activity(df: DataFrame, as_of_us: int | Column | None = None, active_s: float = ACTIVE_S) -> DataFrame:
    """Last records with ``active``: seen less than ``active_s`` before ``as_of_us`` (default: the newest record)."""
    as_of = df.agg(F.max("us")).scalar() if as_of_us is None else as_of_us
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    return last_records(df).withColumn("active", as_of - F.col("last_seen_us") < F.lit(int(active_s * 1e6)))


def connection_state(df: DataFrame, as_of_us: int | Column | None = None, active_s: float = ACTIVE_S) -> DataFrame:
    """Connected gauge per drone, forced to 0 for drones not seen lately."""
    state = with_activity(df, as_of_us, active_s)
    return state.select(
        "drone_id", F.coalesce("swarm_id", F.lit("default")).alias("swarm_id"), "last_seen_us",
        F.when(F.col("active") & F.col("connected"), 1).otherwise(0).alias("connected"),
    )


def swarm_status(df: DataFrame, as_of_us: int | Column | None = None, active_s: float = ACTIVE_S) -> DataFrame:
    """Active drones and mean health of them per swarm; a silent swarm reports 0 and no health."""
    return _swarms(with_activity(df, as_of_us, active_s))


def message_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))


def service_summary(df: DataFrame) -> DataFrame:
    """Requests served and average latency in ms; 0 when there were none."""
    return df.agg(
        F.count(F.lit(1)).alias("requests_served"),
        F.coalesce(F.round(F.avg("latency_s") * 1000, 1), F.lit(0.0)).alias("avg_latency_ms"),
    )


def quantiles(
    df: DataFrame, value: str, keys: Sequence[str] = (), at: Sequence[float] = (0.5, 0.95, 0.99), accuracy: int = 10_000
) -> DataFrame:
    """Quantiles per key from a sketch of bounded size.

    The contract is a bound: a value's rank is off by no more than a share ``1 / accuracy`` of the key's rows.
    Where that must be 0, use :func:`exact_quantiles`.
    """
    return df.groupBy(*keys).agg(*[F.percentile_approx(value, q, accuracy).alias(_quantile_name(q)) for q in at])


def quantile_sketches(df: DataFrame, value: str, keys: Sequence[str], window_s: float, accuracy: int = 1000) -> DataFrame:
    """A mergeable sketch of ``value`` per key and window of event time: ``(keys, start_us, n, sketch)``.

    A sketch has a size of its own, whatever the number of rows, so a table of them is what a stream keeps
    and what coarser levels are made of by :func:`merged_quantiles`. A value's rank is off by no more than
    a share ``1 / accuracy`` of the merged rows, but for odds of one in a hundred. NaN counts as no value.
    """
    size = int(window_s * 1_000_000)
    start = F.floor(F.col("us") / size).cast("bigint") * F.lit(size)
    # The normalised error of a sketch with parameter k is about 2.3 / k to the power of 0.9.
    k = min(65535, max(8, math.ceil((2.296 * accuracy) ** (1 / 0.9021))))
    values = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col("us").isNotNull())
    return values.groupBy(*keys, start.alias("start_us")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str] = (), at: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles per key of all values behind the sketches, of any windows and finer keys. No value is read again."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(_quantile_name(q)) for q in at])


def exact_quantiles(
    df: DataFrame, value: str, keys: Sequence[str] = (), at: Sequence[float] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """Interpolated quantiles per key, exact at any size.

    Equal values are counted first. Values then fall into bands by their logarithm, a thousandth wide;
    from the band totals it is known which bands hold the wanted ranks, and only those are split again,
    into ever narrower bands. The last are so narrow that a band has some thousands of different doubles
    at most, whatever the number of rows: only those are ordered.

    NaN counts as no value, like null. Infinite values are the smallest and largest there are; between one of them
    and a finite value the quantile is infinite, and between opposite ones it is the upper.
    """
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    v = F.col(value)
    near = (
        df.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, v.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumnRenamed("_v", value).withColumn("_below", F.lit(0).cast("bigint"))
    )
    totals = near.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    places = {q: F.lit(float(q)) * (F.col("_total") - 1) for q in at}
    parts = list(keys)
    for level, scale in enumerate(BAND_SCALES):
        band = f"_band{level}"
        # Logarithms of doubles lie between -745 and 710; what is infinite gets the band beyond.
        depth = F.floor(F.least(F.log(F.abs(v)), F.lit(711.0)) * scale).cast("bigint") + int(1000 * scale)
        banded = near.withColumn(band, F.when(v > 0, depth).when(v < 0, -depth).otherwise(0))
        earlier = Window.partitionBy(*parts).orderBy(band).rowsBetween(Window.unboundedPreceding, -1)
        bands = banded.groupBy(*parts, band).agg(F.sum("_n").alias("_size"), F.min("_below").alias("_base")).withColumn(
            "_below", F.col("_base") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        wanted = F.lit(False)
        for place in places.values():
            wanted = wanted | ((F.col("_below") <= F.ceil(place)) & (F.col("_below") + F.col("_size") > F.floor(place)))
        held = bands.join(totals, keys).filter(wanted).select(*parts, band, "_below")
        parts.append(band)
        near = banded.drop("_below").join(held, parts)
    smaller = Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = near.join(totals, keys).withColumn("_first", F.col("_below") + F.coalesce(F.sum("_n").over(smaller), F.lit(0)))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n")), v))

    def interpolated(place: Column) -> Column:
        low, high = at_rank(F.floor(place)), at_rank(F.ceil(place))
        share = F.first(place - F.floor(place))
        return F.when((low == high) | (share == 0), low).when(F.abs(high - low) < float("inf"), low + (high - low) * share).when(
            F.abs(high) == float("inf"), high).when(F.abs(low) == float("inf"), low).otherwise(low * (1 - share) + high * share)

    found = ranked.groupBy(*keys).agg(*[interpolated(p).alias(_quantile_name(q)) for q, p in places.items()])
    return found.drop("_all")


def _quantile_name(q: float) -> str:
    return f"p{round(q * 100)}"


def drone_status(df: DataFrame) -> DataFrame:
    """One status text per drone."""
    return last_records(df).select(
        "drone_id", "swarm_id",
        F.format_string("%s: bat=%.0f%% alt=%.1fm", "drone_id", "battery_percent", "altitude_m").alias("status"),
    )


def status_lines(df: DataFrame, line_of: Column) -> DataFrame:
    """Status texts joined into lines; ``line_of`` names a drone's line, so that a line's length is the caller's choice."""
    return drone_status(df).groupBy(line_of.alias("line")).agg(
        F.array_join(F.array_sort(F.collect_list("status")), " | ").alias("status_line")
    )


def targets_in_view(detections: DataFrame) -> DataFrame:
    """Detections of each drone's latest frame."""
    newest = detections.groupBy("drone_id").agg(F.max("frame_no").alias("frame_no"))
    return detections.join(newest, ["drone_id", "frame_no"], "left_semi")


def target_summary(targets: DataFrame, locked_id: int | None = None) -> DataFrame:
    """Context line per drone: ``#id class`` of every target in view, the locked one marked."""
    mark = F.when(F.col("track_id") == F.lit(locked_id), F.lit(" (LOCKED)")).otherwise(F.lit(""))
    item = F.concat(F.lit("#"), F.col("track_id").cast("string"), F.lit(" "), F.col("class_name"), mark)
    listed = F.array_sort(F.collect_list(F.struct("det_idx", item.alias("text"))))
    return targets.groupBy("drone_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("targets"))
