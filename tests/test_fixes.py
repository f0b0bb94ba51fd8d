"""Fixes judged against the last accepted one: slices in parallel against the plain walk."""

import math
import random

import numpy as np
import pytest

from fleetlens.operators import fixes

pytestmark = pytest.mark.usefixtures("few_partitions")

S = 1_000_000
SCHEMA = "event_id bigint, drone_id string, us bigint, latitude double, longitude double, note string"


def plain(rows, max_speed=30.0, ttl=600):
    last, spoofed = {}, {}
    for event, drone, us, lat, lon, *_ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if lat is None or lon is None or math.isnan(lat):
            continue
        bad = False
        if drone in last and us - last[drone][0] < ttl * S:
            x, y = abs(lat - last[drone][1]) * 111_000, abs(lon - last[drone][2]) * 111_000
            bad = math.sqrt(x * x + y * y) / max((us - last[drone][0]) / 1e6, 0.1) > max_speed
        if not bad:
            last[drone] = (us, lat, lon)
        spoofed[event] = bad
    return {r[0]: spoofed.get(r[0], False) for r in rows}


def run(spark, rows, **how):
    return {r.event_id: r.spoofed for r in fixes.judge_fixes(spark.createDataFrame(rows, SCHEMA).repartition(4), **how).collect()}


@pytest.mark.parametrize("slice_s, ttl", [(20, 600), (40, 25)])
def test_equals_the_plain_walk_with_a_hot_drone(spark, slice_s, ttl):
    rng = random.Random(slice_s)
    rows, where = [], {}
    for i in range(700):
        drone, t = rng.choice(["hot"] * 6 + ["x", None]), i * 0.4 + rng.random() / 5
        if rng.random() < 0.15:
            where[drone] = rng.choice([0.0, 0.05, 1.0])  # it jumps, and stays there for a while
        lat = where.get(drone, 0.0) + rng.random() * 1e-5
        rows.append((i, drone, int(t * S), lat, 0.0, "n"))
    rows += [(900, "hot", None, 0.0, 0.0, None), (901, "hot", 50 * S, None, 0.0, None), (902, "x", 50 * S, float("nan"), 0.0, None)]
    want = plain(rows, ttl=ttl)
    assert run(spark, rows, slice_us=slice_s * S, ttl_s=ttl) == want and 50 < sum(want.values()) < 650


def test_the_fix_after_a_spoofed_one_is_not_flagged(spark):
    rows = [(1, "d", 1 * S, 0.0, 0.0, ""), (2, "d", 2 * S, 1.0, 0.0, ""), (3, "d", 3 * S, 0.0, 0.0, "")]
    assert run(spark, rows) == {1: False, 2: True, 3: False}


def test_a_wrong_guess_travels_through_all_slices(spark):
    """The first fix is far from all others, which stay rejected over many slices until the distance is allowed."""
    rows = [(0, "d", 0, 0.0, 0.0, "")] + [(i, "d", i * S, 0.05, 0.0, "") for i in range(1, 300)]
    got = run(spark, rows, slice_us=50 * S)
    assert got == plain(rows) and sum(got.values()) == 184  # 5,550 m at 30 m/s


def test_rows_and_columns_stay(spark):
    empty = fixes.judge_fixes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["event_id", "drone_id", "us", "latitude", "longitude", "note", "spoofed"]
    kept = fixes.accepted_fixes(spark.createDataFrame([(1, "d", 1 * S, 0.0, 0.0, "a"), (2, "d", 2 * S, 9.0, 0.0, "b"), (3, None, None, 9.0, 0.0, "c")], SCHEMA))
    assert {r.note for r in kept.collect()} == {"a", "c"} and "spoofed" not in kept.columns


def test_runs_equal_single_steps():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(0, 40))
        us = np.sort(rng.integers(0, 60 * S, n))
        lat = rng.choice([0.0, 0.002, 0.004, 0.02], n)
        last = None if rng.random() < 0.3 else (-5 * S, float(rng.choice([0.0, 0.02])), 0.0)
        want, state = [], last
        for u, x in zip(us.tolist(), lat.tolist()):
            ok = state is None or bool(fixes.reachable(np.array([u]), np.array([x]), np.zeros(1), state, 30.0, 20 * S)[0])
            state = (u, x, 0.0) if ok else state
            want.append(ok)
        assert fixes.accepted_rows(us, lat, np.zeros(n), last, 30.0, 20 * S).tolist() == want
