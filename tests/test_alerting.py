"""Alert rules, silence and connection state on streams, against plain rules applied one tick after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import alerting, jobs
from fleetlens.streaming.alerting import SILENCE, Watch

pytestmark = pytest.mark.usefixtures("few_partitions")

S = 1_000_000
SCHEMA = "event_id bigint, drone_id string, swarm_id string, us bigint, battery_percent double, connected boolean"
WATCHES = [Watch("low", "battery_percent", "<", 30.0, 30), Watch("lost", "connected", "==", 0.0, 15, stale_s=30),
           alerting.silence("silent", 60)]


def plain(rows, watches, until, lookback_s=300, forget_s=86_400):
    """Every tick of every drone by itself."""
    out = set()
    for drone in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == drone and r[3] is not None), key=lambda r: (r[3], r[0]))
        if not mine:
            continue
        for w in watches:
            since = None
            for tick in range(0, until + 1, 15 * S):
                if w.field == SILENCE:
                    before = [r[3] for r in mine if r[3] <= tick]
                    value = (tick - max(before)) / S if before else None
                else:
                    column = 4 if w.field == "battery_percent" else 5
                    taken = [(r[3] // (5 * S) * 5 * S + 5 * S, float(r[column])) for r in mine if r[column] is not None]
                    taken = [t for t in taken if t[0] <= tick]
                    value = taken[-1][1] if taken else None
                    age = tick - taken[-1][0] if taken else 0
                    if taken and w.stale_s and age >= w.stale_s * S:
                        value, age = 0.0, age - w.stale_s * S
                    if age >= lookback_s * S:
                        value = None
                held = value is not None and {"<": value < w.threshold, "==": value == w.threshold, ">=": value >= w.threshold}[w.op]
                if tick > max(r[3] for r in mine) + forget_s * S:
                    held = False
                since = (tick if since is None else since) if held else None
                if held:
                    out.add((w.alert, drone, tick, since, "firing" if tick - since >= w.for_s * S else "pending", round(value, 6)))
    return out


def feed(spark, tmp_path, batches, make):
    """One run per batch, from the checkpoint of the run before."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    jobs.use_rocksdb(spark)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("ts", F.timestamp_micros("us"))
        jobs.run_append(make(stream), out, state, availableNow=True).awaitTermination()
    return out


def closing(us):
    return [(10**9, "zz", "s", us + 5 * S, 99.0, True)]


def found(spark, path):
    return {(r.alert, r.drone_id, r.tick, r.since, r.state, round(r.value, 6)) for r in spark.read.parquet(path).collect() if r.drone_id != "zz"}


def rows_of(seed, n=260, span=900):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.3, 1.7, 4.0]) * span / n / 2
        drone = rng.choice(["a"] * 5 + ["b", "c"])
        gap = drone == "b" and 150 < t < 640  # b falls silent for long, c for good
        if gap or (drone == "c" and t > 200):
            continue
        rows.append((i, drone, "s", int(t * S), rng.choice([None, 50.0, 29.5, 29.5, 10.0]), rng.choice([None, True, True, False])))
    return rows


@pytest.mark.parametrize("seed, cuts", [(1, [90, 91])])
def test_ticks_equal_plain_rules_over_restarts(spark, tmp_path, seed, cuts):
    rows = rows_of(seed)
    end = max(r[3] for r in rows)
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    path = feed(spark, tmp_path, [*batches, closing(end)], lambda s: alerting.alert_stream(s, WATCHES))
    want = plain(rows, WATCHES, end)
    assert found(spark, path) == want
    assert {(a, s) for a, _, _, _, s, _ in want} >= {("low", "firing"), ("low", "pending"), ("lost", "firing"), ("silent", "firing")}
    assert any(d == "c" and t > 400 * S for a, d, t, *_ in want if a == "silent")


def test_a_silent_drone_is_noticed_without_input_and_late_rows_change_nothing_judged(spark, tmp_path):
    a = [(1, "a", "s", 10 * S, 20.0, True), (2, "b", "s", 10 * S, 90.0, True), (9, "b", "s", None, 1.0, True)]
    b = [(3, "b", "s", 100 * S, 90.0, True)]
    late = [(4, "a", "s", 20 * S, 90.0, True), (5, "b", "s", 130 * S, 90.0, True)]  # a's record comes when its time is long judged
    path = feed(spark, tmp_path, [a, b, late, closing(200 * S)], lambda s: alerting.alert_stream(s, WATCHES))
    got = found(spark, path)
    assert got == plain([r for r in a + b + late if r[0] != 4], WATCHES, 200 * S)
    assert ("silent", "a", 195 * S, 75 * S, "firing", 185.0) in got and ("lost", "a", 60 * S, 45 * S, "firing", 0.0) in got


def test_a_drone_silent_for_long_is_dropped(spark, tmp_path):
    rows = [(1, "a", "s", 10 * S, 20.0, True), (2, "b", "s", 400 * S, 90.0, True)]
    path = feed(spark, tmp_path, [rows[:1], rows[1:], closing(500 * S), [(3, "a", "s", 600 * S, 20.0, True)], closing(620 * S)],
                lambda s: alerting.alert_stream(s, WATCHES, forget_s=100))
    ticks = {t for a, d, t, *_ in found(spark, path) if d == "a" and a == "silent"}
    assert ticks == {75 * S, 90 * S, 105 * S}
    assert {t for a, d, t, *_ in found(spark, path) if d == "a" and a == "low"} >= {15 * S, 30 * S, 615 * S}


def test_connection_state_ages_without_input(spark, tmp_path):
    batches = [[(1, "a", "s1", 10 * S, 1.0, True), (2, "b", None, 10 * S, 1.0, True), (3, "c", "s1", 11 * S, 1.0, False)],
               [(4, "b", None, 35 * S, 1.0, True), (5, "b", None, 36 * S, 1.0, None)], closing(41 * S)]
    path = feed(spark, tmp_path, batches, alerting.connection_stream)
    def state():
        return {r.drone_id: (r.swarm_id, r.last_seen_us, r.connected) for r in alerting.current_connections(spark, path).collect() if r.drone_id != "zz"}
    assert state() == {"a": ("s1", 10 * S, 0), "b": ("default", 36 * S, 0), "c": ("s1", 11 * S, 0)}
    feed(spark, tmp_path, [[(6, "a", "s2", 50 * S, 1.0, True), (7, "b", None, 50 * S, 1.0, True)], [(8, "a", "s2", 70 * S, 1.0, True)], closing(85 * S)],
         alerting.connection_stream)
    assert state() == {"a": ("s2", 70 * S, 1), "b": ("default", 50 * S, 0), "c": ("s1", 11 * S, 0)}
    lost = {(r.drone_id, r.at_us) for r in spark.read.parquet(path).filter("connected = 0 and at_us > last_seen_us").collect()}
    assert {("a", 40 * S), ("b", 80 * S)} <= lost


def test_runs_of_ticks():
    ticks = np.arange(0, 8 * 15, 15)
    held = np.array([1, 1, 0, 1, 0, 0, 1, 1], dtype=bool)
    assert alerting.since_when(held, ticks, -1)[held].tolist() == [0, 0, 45, 90, 90]
    assert alerting.since_when(held, ticks, -30)[held].tolist() == [-30, -30, 45, 90, 90]
    assert len(alerting.since_when(held[:0], ticks[:0], 7)) == 0
