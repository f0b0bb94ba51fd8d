"""Spoofed fixes judged against the last *accepted* fix, in batch, with a drone's history in many tasks.

What a fix is measured against depends on all decisions before it, so a history cannot be cut without knowing
the last accepted fix at the cut. It is guessed: every time slice is walked from an assumed entry, the last fix
before it. A slice hands on its last accepted fix; where that is not what the next slice assumed, the next
one is walked again from the right entry, and only that. Slices forget their entry as soon as two walks
accept the same fix, so mostly one correction is enough; at the latest as many as a drone has slices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.operators.anomalies import METERS_PER_DEGREE, MIN_STEP_S, STATE_TTL_S
from fleetlens.operators.grouped import Group, map_groups, repeat
from fleetlens.session import written

MAX_SPEED_MS = 30.0
DEFAULT_SLICE_US = 60_000_000
_ENTRY = ["entry_us", "entry_lat", "entry_lon"]
_NONE = -(1 << 62)  # the time of a fix that is not there


def reachable(us: np.ndarray, lat: np.ndarray, lon: np.ndarray, last: tuple[int, float, float], max_speed_ms: float, ttl_us: int) -> np.ndarray:
    """Which fixes can be reached from ``last`` at the allowed speed; one that is too old allows all."""
    x, y = np.abs(lat - last[1]) * METERS_PER_DEGREE, np.abs(lon - last[2]) * METERS_PER_DEGREE
    age = us - last[0]
    return (np.sqrt(x * x + y * y) / np.maximum(age / 1e6, MIN_STEP_S) <= max_speed_ms) | (age >= ttl_us)


def accepted_rows(us: np.ndarray, lat: np.ndarray, lon: np.ndarray, last: tuple[int, float, float] | None, max_speed_ms: float,
                  ttl_us: int) -> np.ndarray:
    """Rows of a sorted slice that are accepted one after another, each measured against the last accepted one.

    Rows that are each reachable from the row before are accepted as one run; only where a run breaks is the next
    acceptable row looked for.
    """
    n = len(us)
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    x, y = np.abs(np.diff(lat)) * METERS_PER_DEGREE, np.abs(np.diff(lon)) * METERS_PER_DEGREE
    age = np.diff(us)
    follows = (np.sqrt(x * x + y * y) / np.maximum(age / 1e6, MIN_STEP_S) <= max_speed_ms) | (age >= ttl_us)
    breaks = np.append(np.flatnonzero(~follows), n - 1)  # the last rows of runs
    at = 0
    while at < n:
        if last is not None:
            span = 8
            while at < n:
                found = np.flatnonzero(reachable(us[at:at + span], lat[at:at + span], lon[at:at + span], last, max_speed_ms, ttl_us))
                if len(found):
                    at += int(found[0])
                    break
                at, span = at + span, span * 2
            if at >= n:
                break
        end = int(breaks[np.searchsorted(breaks, at)])
        out[at:end + 1] = True
        last = (int(us[end]), float(lat[end]), float(lon[end]))
        at = end + 1
    return out


def _entered(group: Group) -> tuple[tuple[int, float, float] | None, Group]:
    """The entry that stands in the first row, and the fixes after it."""
    first = int(group["us"][0])
    return None if first == _NONE else (first, float(group["lat"][0]), float(group["lon"][0])), {k: v[1:] for k, v in group.items()}


def _walk(fixes: DataFrame, entries: DataFrame, how: tuple[float, int], flags: bool) -> DataFrame:
    """Walk the slices of ``entries``: per slice the fix it hands on, or with ``flags`` per fix whether it is accepted."""
    entry = entries.select("drone", "slice", F.lit(0).alias("row"), F.lit(None).cast("bigint").alias("tie"), F.coalesce("entry_us", F.lit(_NONE)).alias("us"),
                           F.coalesce("entry_lat", F.lit(0.0)).alias("lat"), F.coalesce("entry_lon", F.lit(0.0)).alias("lon"))
    rows = fixes.join(entries.select("drone", "slice"), ["drone", "slice"], "left_semi").withColumn("row", F.lit(1)) if not flags else (
        fixes.withColumn("row", F.lit(1)))
    stacked = entry.withColumn("tie", F.lit(0).cast("bigint")).unionByName(rows)

    def hand_on(group: Group) -> Group:
        last, rest = _entered(group)
        taken = np.flatnonzero(accepted_rows(rest["us"], rest["lat"], rest["lon"], last, *how))
        i = taken[-1] + 1 if len(taken) else 0  # nothing accepted: the entry is handed on
        return {"drone": repeat(group["drone"][0], 1), "slice": group["slice"][:1], "us": group["us"][i:i + 1],
                "lat": group["lat"][i:i + 1], "lon": group["lon"][i:i + 1]}

    def mark(group: Group) -> Group:
        last, rest = _entered(group)
        return {"tie": rest["tie"], "accepted": accepted_rows(rest["us"], rest["lat"], rest["lon"], last, *how)}

    if flags:
        return map_groups(stacked, ["drone", "slice"], ["row", "us", "tie"], mark, "tie bigint, accepted boolean")
    return map_groups(stacked, ["drone", "slice"], ["row", "us", "tie"], hand_on, "drone string, slice bigint, us bigint, lat double, lon double")


def judge_fixes(
    df: DataFrame, max_speed_ms: float = MAX_SPEED_MS, ttl_s: int = STATE_TTL_S, slice_us: int = DEFAULT_SLICE_US, tie: str = "event_id",
) -> DataFrame:
    """Telemetry with ``spoofed``: the fix cannot be reached from the drone's last accepted one.

    Fixes are taken in the order of time and ``tie``, which is unique. An accepted fix ``ttl_s`` old or older says
    nothing. A record without a time or a position is not judged, and nothing is measured against it. Records of
    no drone are one drone's. Walks run when the query is built: the fixes are written out once, narrow.
    """
    position = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude")
    fixes = written(df.filter(F.col("us").isNotNull() & position).select(
        # A drone's key is text, with a mark in front so that none is not the empty one.
        F.coalesce(F.concat(F.lit("="), F.col("drone_id").cast("string")), F.lit("")).alias("drone"),
        F.floor(F.col("us") / slice_us).cast("bigint").alias("slice"), "us", F.col(tie).cast("bigint").alias("tie"),
        F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")), "fixes")
    how = (float(max_speed_ms), int(ttl_s * 1_000_000))
    order = Window.partitionBy("drone").orderBy("slice")  # one row per slice

    def entered(exits: DataFrame) -> DataFrame:
        return exits.select("drone", "slice", *[F.lag(c).over(order).alias(e) for c, e in zip(("us", "lat", "lon"), _ENTRY)])

    newest = F.max(F.struct("us", "tie", "lat", "lon")).alias("last")
    entries = written(entered(fixes.groupBy("drone", "slice").agg(newest).select("drone", "slice", "last.us", "last.lat", "last.lon")), "fix-entries")
    exits = written(_walk(fixes, entries, how, False), "fix-exits")
    while True:
        right = entered(exits)
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("drone", "slice", *_ENTRY)]
        wrong = written(right.alias("n").join(entries.alias("o"), same, "left_anti"), "fix-wrong")
        if wrong.isEmpty():
            break
        again = _walk(fixes, wrong, how, False)
        exits = written(exits.join(wrong.select("drone", "slice"), ["drone", "slice"], "left_anti").unionByName(again), "fix-exits")
        entries = written(entries.join(wrong.select("drone", "slice"), ["drone", "slice"], "left_anti").unionByName(wrong), "fix-entries")
    flags = _walk(fixes, entries, how, True).select(F.col("tie").alias("_tie"), "accepted")
    judged = df.join(flags, F.col(tie) == F.col("_tie"), "left")
    return judged.select(*df.columns, F.coalesce(~F.col("accepted"), F.lit(False)).alias("spoofed"))


def accepted_fixes(df: DataFrame, max_speed_ms: float = MAX_SPEED_MS, ttl_s: int = STATE_TTL_S) -> DataFrame:
    """Telemetry without the spoofed fixes."""
    return judge_fixes(df, max_speed_ms, ttl_s).filter(~F.col("spoofed")).drop("spoofed")
