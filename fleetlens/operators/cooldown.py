"""Alert cooldown: emit an alert only if enough time has passed since the last *emitted* one.

The rule is greedy, so a drone's alerts cannot be judged one by one. They can be judged slice
by slice: what a slice does depends on the past only through the time ``s`` of the last
emission, and as a function of ``s`` it is a short step function.

With ``u = t - period``, a row is emitted when ``u > s``. The first emission of a slice, given
``s``, is therefore the first row whose running maximum of ``u`` exceeds ``s``, and the same
holds for every following emission.

1. ``summarise``: each ``(drone, type, slice)`` yields its step function (upper bound of ``s``
   -> last emission of the slice).
2. ``enter``: each ``(drone, type)`` folds its slices' step functions into the ``s`` with which
   every slice is entered. A drone's slices are bounded by time, not by its number of alerts.
3. ``replay``: each slice emits, starting from its ``s``.

That is for drones with very many alerts of a type; the alerts of all others are walked as they are.

Only times and periods pass through these steps. The alerts join back by time at the end.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.grouped import Group, map_groups, repeat
from fleetlens.session import written

KEY = ["drone_id", "alert_type"]
CRITICAL_S, WARNING_S = 10.0, 30.0
DEFAULT_SLICE_US = 600_000_000
#: Instants of one drone and type that are walked at once; more are walked slice by slice.
WHOLE = 200_000


def emission_rows(t: np.ndarray, period: np.ndarray, last: int) -> list[int]:
    """Rows of one sorted slice that are emitted greedily, given the last emission before it."""
    top = np.maximum.accumulate(t - period)
    out: list[int] = []
    i = int(np.searchsorted(top, last, side="right"))
    while i < len(t):
        out.append(i)
        i = int(np.searchsorted(top, int(t[i]), side="right"))
    return out


def emission_times(t: np.ndarray, period: np.ndarray, last: int) -> list[int]:
    return t[emission_rows(t, period, last)].tolist() if len(t) else []


def step_function(t: np.ndarray, period: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """Bounds and exits: an entry time below ``bounds[i]`` (and not below the one before) leaves
    the slice with last emission ``exits[i]``; at or above all bounds nothing is emitted."""
    u = t - period
    top = np.maximum.accumulate(u)
    following = np.searchsorted(top, t, side="right")
    exits = t.copy()
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            exits[i] = exits[following[i]]
    rising = np.flatnonzero(np.concatenate(([True], u[1:] > top[:-1])))
    bounds: list[int] = []
    results: list[int] = []
    for i in rising:
        if results and results[-1] == exits[i]:
            bounds[-1] = int(u[i])
        else:
            bounds.append(int(u[i]))
            results.append(int(exits[i]))
        if u[i] >= start:  # emissions before the slice are earlier than its start
            break
    return bounds, results


def _labels(group: Group, n: int) -> Group:
    return {name: repeat(group[name][0], n) for name in KEY}


def _summarise(group: Group) -> Group:
    bounds, exits = step_function(group["us"], group["period"], int(group["slice_start"][0]))
    n = len(bounds)
    return {
        **_labels(group, n), "slice": np.full(n, group["slice"][0]),
        "bound": np.asarray(bounds, dtype="int64"), "exit": np.asarray(exits, dtype="int64"),
    }


def _enter(group: Group) -> Group:
    """Walk the slices of one drone and type; each slice's step function is a run of rows."""
    starts = np.flatnonzero(np.concatenate(([True], group["slice"][1:] != group["slice"][:-1])))
    ends = np.append(starts[1:], len(group["slice"]))
    last, entry = 0, []
    for begin, end in zip(starts, ends):
        entry.append(last)
        i = begin + int(np.searchsorted(group["bound"][begin:end], last, side="right"))
        if i < end:
            last = int(group["exit"][i])
    return {
        **_labels(group, len(starts)), "slice": group["slice"][starts],
        "entry": np.asarray(entry, dtype="int64"),
    }


def _replay(group: Group) -> Group:
    """The first row holds the entry time, the others the slice's instants."""
    last = int(group["entry"][0])
    times = emission_times(group["us"][1:], group["period"][1:], last)
    return {
        **_labels(group, len(times)), "us": np.asarray(times, dtype="int64"),
        "last_us": np.asarray([last, *times][: len(times)], dtype="int64"),
    }


def _walk(group: Group) -> Group:
    """All instants of one drone and type."""
    times = emission_times(group["us"], group["period"], 0)
    return {
        **_labels(group, len(times)), "us": np.asarray(times, dtype="int64"),
        "last_us": np.asarray([0, *times][: len(times)], dtype="int64"),
    }


def _same(left: str, right: str) -> Column:
    return reduce(and_, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in KEY))


_EMITTED = "drone_id string, alert_type string, us bigint, last_us bigint"


def _emissions(instants: DataFrame, slice_us: int, whole: int) -> DataFrame:
    """The instants that are emitted, each with the emission before it.

    Keys of few instants are walked in one pass. The instants are counted for it; only where a key has more than
    ``whole`` of them are that key's cut into slices.
    """
    counts = instants.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.filter(F.col("n") > whole).select(*KEY), "hot-alerts")
    if hot.isEmpty():
        return map_groups(instants, KEY, ["us"], _walk, _EMITTED)
    few = instants.alias("i").join(hot.alias("h"), _same("i", "h"), "left_anti")
    many = instants.alias("i").join(hot.alias("h"), _same("i", "h"), "left_semi")
    return map_groups(few, KEY, ["us"], _walk, _EMITTED).unionByName(_sliced_emissions(many, slice_us))


def _sliced_emissions(instants: DataFrame, slice_us: int) -> DataFrame:
    instants = instants.select(
        *KEY, "us", "period",
        F.expr(f"us div {slice_us}").alias("slice"),
        F.expr(f"(us div {slice_us}) * {slice_us}").alias("slice_start"),
    )
    by_slice = [*KEY, "slice"]
    summary = map_groups(
        instants, by_slice, ["us"], _summarise,
        "drone_id string, alert_type string, slice bigint, bound bigint, exit bigint",
    )
    entries = map_groups(
        summary, KEY, ["slice", "bound"], _enter,
        "drone_id string, alert_type string, slice bigint, entry bigint",
    )
    seeds = entries.select(*by_slice, F.lit(0).cast("bigint").alias("period"), "entry", F.lit(0).alias("kind"),
                           F.lit(0).cast("bigint").alias("us"))
    rows = instants.select(*by_slice, "period", F.lit(0).cast("bigint").alias("entry"), F.lit(1).alias("kind"), "us")
    return map_groups(seeds.unionByName(rows), by_slice, ["kind", "us"], _replay, _EMITTED)


def cooldown(
    alerts: DataFrame, critical_s: float = CRITICAL_S, warning_s: float = WARNING_S,
    slice_us: int = DEFAULT_SLICE_US, whole: int = WHOLE,
) -> DataFrame:
    """Alerts left after the cooldown, per drone and alert type.

    An alert is emitted if strictly more than its own severity's period has passed since the
    last emitted alert. Before the first emission that time is 0. Alerts of no drone or no type are a key of
    their own. An alert without a time cannot be judged: it goes out, and silences nothing. The alerts are
    written out first, since several steps read them and each would otherwise score the telemetry again.
    """
    written_out = written(alerts, "alerts")
    alerts = written_out.filter(F.col("us").isNotNull())
    period = F.when(F.col("severity") == "critical", int(critical_s * 1e6)).otherwise(int(warning_s * 1e6)).cast("bigint")
    # rows of one instant collapse to the easiest of them to emit, before any shuffle
    instants = alerts.groupBy(*KEY, "us").agg(F.min(period).alias("period"))
    emitted = _emissions(instants, slice_us, whole)
    names = [c for c in alerts.columns if c not in (*KEY, "us")]
    passed = emitted.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "us")], "last_us")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*KEY, "us")))
    at_instant = alerts.join(passed, same).filter(F.col("us") - F.col("last_us") > period)
    # several alerts of one type at one instant: only the first goes out
    first = at_instant.groupBy(*KEY, "us").agg(F.min_by(F.struct(*names), "event_id").alias("alert"))
    cooled = first.select(*KEY, "us", "alert.*").select(alerts.columns)
    return cooled.unionByName(written_out.filter(F.col("us").isNull()))
