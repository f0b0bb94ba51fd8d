"""The sliced cooldown against the greedy rule, applied one by one."""

import random

import numpy as np
import pytest

from fleetlens.operators.cooldown import cooldown, emission_times, step_function

SCHEMA = "drone_id string, alert_type string, event_id bigint, us bigint, severity string"
S = 1_000_000


def greedy(rows):
    last, out = {}, set()
    for drone, kind, event, us, severity in sorted(rows, key=lambda r: (r[3], r[2])):
        period = 10 * S if severity == "critical" else 30 * S
        if us - last.get((drone, kind), 0) > period:
            out.add(event)
            last[drone, kind] = us
    return out


def run(spark, rows, slice_us=600 * S, whole=0):
    """By slices, unless ``whole`` says how many alerts of a key are walked at once."""
    return {r.event_id for r in cooldown(spark.createDataFrame(rows, SCHEMA), slice_us=slice_us, whole=whole).collect()}


@pytest.mark.parametrize("slice_s", [7, 45, 10_000])
def test_equals_greedy_rule_with_a_hot_drone(spark, slice_s):
    rng = random.Random(slice_s)
    rows = [(rng.choice(["hot"] * 6 + ["x", "y"]), rng.choice(["heat", "motor"]), i, rng.randrange(0, 1500) * S // 2,
             rng.choice(["warning", "critical"])) for i in range(900)]
    assert run(spark, rows, slice_s * S) == greedy(rows) == run(spark, rows, slice_s * S, whole=120) == run(spark, rows, whole=10**6)


def test_exact_periods_are_not_enough(spark):
    rows = [("d", "k", 1, 40 * S, "warning"), ("d", "k", 2, 70 * S, "warning"), ("d", "k", 3, 70 * S + 1, "warning"),
            ("e", "k", 4, 40 * S, "critical"), ("e", "k", 5, 50 * S, "critical"), ("e", "k", 6, 50 * S + 1, "critical")]
    assert run(spark, rows) == {1, 3, 4, 6}


def test_critical_follows_warning_sooner_and_types_are_apart(spark):
    rows = [("d", "k", 1, 40 * S, "warning"), ("d", "k", 2, 52 * S, "critical"), ("d", "m", 3, 53 * S, "warning"),
            ("d", "k", 4, 60 * S, "warning")]
    assert run(spark, rows) == {1, 2, 3}


def test_one_instant_emits_once(spark):
    rows = [("d", "k", 2, 40 * S, "critical"), ("d", "k", 1, 40 * S, "warning"), ("d", "k", 3, 40 * S, "critical")]
    assert run(spark, rows) == {1}


def test_alerts_near_time_zero_wait(spark):
    assert run(spark, [("d", "k", 1, 9 * S, "critical"), ("d", "k", 2, 11 * S, "critical")]) == {2}


def test_step_function_equals_replay():
    rng = np.random.default_rng(3)
    for _ in range(300):
        start = 1000
        t = np.sort(rng.integers(start, start + 200, rng.integers(1, 40)))
        t = np.unique(t)
        period = rng.choice([10, 30], len(t))
        bounds, exits = step_function(t, period, start)
        for last in range(start - 60, start):
            times = emission_times(t, period, last)
            i = int(np.searchsorted(bounds, last, side="right"))
            assert (exits[i] if i < len(exits) else last) == (times[-1] if times else last)


def test_alerts_without_a_time_or_a_drone(spark):
    rows = [("d", "k", 1, 40 * S, "warning"), ("d", "k", 2, None, "warning"), ("d", "k", 3, 41 * S, "warning"), (None, "k", 4, 40 * S, "warning"),
            (None, "k", 5, 41 * S, "critical"), (None, None, 6, 40 * S, "critical"), (None, "k", 7, None, "warning"), ("d", "k", 8, None, "warning")]
    assert run(spark, rows) == run(spark, rows, whole=2) == run(spark, rows, whole=100) == {1, 2, 4, 6, 7, 8}
    assert run(spark, [("d", "k", 1, None, "warning")]) == {1} and cooldown(spark.createDataFrame([], SCHEMA)).count() == 0
