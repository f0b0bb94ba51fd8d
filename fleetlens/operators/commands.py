"""Mission commands, message routing, battery events and threat flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.columns import ColumnLike, col, latest
from fleetlens.operators.lookups import COMMAND_MODES
from fleetlens.operators.ordered import DEFAULT_SLICE_US, with_history

# Keywords of the two routing tables, in order; the first rule that matches wins.
ROUTES = [
    ("analyst", ["analyst", "check", "scan"]),
    ("tactical", ["tactical", "execute", "engage"]),
]
TOOL_ROUTES = [
    ("analyst", ["analyst", "status", "check"]),
    ("tactical", ["tactical", "engage", "land", "follow"]),
]
END = "end"

# Battery event limits and threat texts.
LOW_BATTERY, CRITICAL_BATTERY = 20.0, 10.0
NO_THREATS = "No immediate threats."


def route(text: ColumnLike, rules: Sequence[tuple[str, list[str]]] = ROUTES, has_tool_calls: Column | None = None) -> Column:
    """Destination of a message by keyword, on the whole lower-cased text."""
    lowered = F.lower(col(text))
    target = F.when(has_tool_calls, F.lit("tools")) if has_tool_calls is not None else None
    for name, words in rules:
        found = lowered.rlike("|".join(words))
        target = F.when(found, F.lit(name)) if target is None else target.when(found, F.lit(name))
    return target.otherwise(F.lit(END))


def command_mode(command: ColumnLike) -> Column:
    mode = None
    for name, value in COMMAND_MODES.items():
        is_it = col(command) == name
        mode = F.when(is_it, F.lit(value)) if mode is None else mode.when(is_it, F.lit(value))
    return mode.otherwise(F.lit("unknown"))


def current_mode(commands: DataFrame, tie: str = "event_id") -> DataFrame:
    """Mission mode per drone after its last known command."""
    moded = commands.withColumn("mode", command_mode("command")).filter(F.col("mode") != "unknown")
    return moded.groupBy("drone_id").agg(latest("mode", "us", tie).alias("mode"))


def battery_events(df: DataFrame) -> DataFrame:
    """One event per record below 20 %, without debouncing."""
    percent = F.col("battery_percent")
    return df.filter(percent < LOW_BATTERY).withColumns({
        "event_type": F.when(percent < CRITICAL_BATTERY, "critical_battery").otherwise("low_battery"),
        "details": F.concat(F.lit("Battery at "), percent.cast("string"), F.lit("%")),
    })


def threats(df: DataFrame) -> DataFrame:
    flags = F.array_compact(F.array(
        F.when(F.col("battery_percent") < LOW_BATTERY, F.lit("CRITICAL BATTERY")),
        F.when(~F.col("connected"), F.lit("DISCONNECTED")),
    ))
    listed = F.concat(F.lit("THREATS: ['"), F.array_join("threats", "', '"), F.lit("']"))
    return df.withColumn("threats", flags).withColumn(
        "threat_text", F.when(F.size("threats") > 0, listed).otherwise(F.lit(NO_THREATS))
    )


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], right_fields: Sequence[str], name: str = "match",
    tie: str = "event_id", width_us: int = DEFAULT_SLICE_US,
) -> DataFrame:
    """Left rows with the latest right row of the same key at or before them (null if none).

    Both sides are stacked into one timeline per key and the last right row is carried forward,
    so no left row ever meets more than one right row. On equal times the right row comes first.
    """
    left_fields = F.struct(*left.columns)
    stacked = left.select(
        *keys, "us", (F.col(tie) + F.lit(4_000_000_000_000_000_000)).alias("_tie"), left_fields.alias("_left"),
        F.lit(None).cast(right.select(F.struct(*right_fields)).schema[0].dataType).alias("_right"),
    ).unionByName(right.select(
        *keys, "us", F.col(tie).alias("_tie"),
        F.lit(None).cast(left.select(left_fields).schema[0].dataType).alias("_left"),
        F.struct(*right_fields).alias("_right"),
    ))
    matched = with_history(stacked, keys, "us", "_tie", carried={name: "_right"}, width=width_us)
    return matched.filter(F.col("_left").isNotNull()).select("_left.*", name)


def command_latency(commands: DataFrame, telemetry: DataFrame, width_us: int = DEFAULT_SLICE_US) -> DataFrame:
    """Milliseconds from the drone's latest telemetry to each command."""
    matched = asof_join(commands, telemetry, ["drone_id"], ["us", "event_id"], "telemetry", width_us=width_us)
    return matched.withColumn("latency_ms", (F.col("us") - F.col("telemetry.us")) / F.lit(1000.0))
