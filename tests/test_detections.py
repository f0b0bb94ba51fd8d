"""Overlap suppression and target following on small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import detections as D

BOXES = "frame_no bigint, det_idx bigint, det_id bigint, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def kept(spark, rows, limit=0.5, fold=64):
    return {r.det_id for r in D.nms(spark.createDataFrame(rows, BOXES), ["frame_no"], limit, fold=fold).collect()}


def brute(rows, limit=0.5):
    out = set()
    for frame in {r[0] for r in rows}:
        chosen = []
        for r in sorted((r for r in rows if r[0] == frame), key=lambda r: (-r[3], r[1])):
            def iou(k):
                w = max(0, min(k[6], r[6]) - max(k[4], r[4]))
                h = max(0, min(k[7], r[7]) - max(k[5], r[5]))
                union = (k[6] - k[4]) * (k[7] - k[5]) + (r[6] - r[4]) * (r[7] - r[5]) - w * h
                return w * h / union if union else np.nan
            if all(iou(k) <= limit for k in chosen):
                chosen.append(r)
        out |= {r[2] for r in chosen}
    return out


def test_random_frames_and_a_hot_one(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        x, y = rng.randrange(160), rng.randrange(160)
        rows.append((rng.choice([0] * 8 + list(range(8))), i, i, rng.choice([0.3, 0.5, 0.7]), x, y, x + rng.randrange(40), y + rng.randrange(40)))
    assert kept(spark, rows) == brute(rows)


def boxes_of(rng, n, frame, spread, sizes=(40, 41), first=0):
    out = []
    for i in range(first, first + n):
        x, y = rng.randrange(spread), rng.randrange(spread)
        out.append((frame, i, i, rng.choice([0.3, 0.5, 0.7, 0.9]), x, y, x + rng.randrange(*sizes), y + rng.randrange(*sizes)))
    return out


@pytest.mark.parametrize("limit", [0.05, 0.3, 0.5, 0.8, 0.95])
def test_rounds_equal_the_rule_at_any_limit(spark, limit):
    """All frames as large ones: sizes from a pixel to half the frame, empty boxes, and small ones beside large."""
    rng = random.Random(int(limit * 100))
    rows = boxes_of(rng, 300, 0, 200, (0, 60)) + boxes_of(rng, 200, 1, 60, (1, 9), 300) + boxes_of(rng, 40, 2, 3, (0, 2), 500)
    assert kept(spark, rows, limit, fold=0) == brute(rows, limit) == kept(spark, rows, limit, fold=10**6)


def test_long_chains_and_crowds_equal_the_rule(spark, monkeypatch):
    from fleetlens.operators import suppression

    rng = random.Random(9)
    chain = [(0, i, i, 0.9 - i * 1e-3, 4 * i, 0, 4 * i + 20, 10) for i in range(150)]  # each depends on the one before
    crowd = boxes_of(rng, 400, 1, 6, (40, 44), 200)  # two or three objects
    loose = boxes_of(rng, 200, 2, 4000, first=700)
    rows = chain + crowd + loose
    assert kept(spark, rows, fold=10) == brute(rows)
    monkeypatch.setattr(suppression, "ROUNDS", 1)
    monkeypatch.setattr(suppression, "CROWDED", 4)
    assert kept(spark, rows, fold=10) == brute(rows)


def test_a_large_frame_with_a_wide_box(spark):
    """One plan for all frames: 5,000 disjoint boxes and one as wide as the frame."""
    rows = [(1, i, i, 0.5, 20 * i, 0, 20 * i + 10, 10) for i in range(5000)] + [(1, 5000, 5000, 0.9, 0, 0, 100_000, 10)]
    assert kept(spark, rows) == set(range(5001))


def test_fractions_decide(spark):
    rows = [("d", 1, 0, i, i, 1, 0.9, 0.0, 0.0, 10.0, h, "car") for i, h in enumerate((10.10, 10.14, 10.12))]
    tracks = spark.createDataFrame(rows, TRACKS.replace("x1 bigint, y1 bigint, x2 bigint, y2 bigint", "x1 double, y1 double, x2 double, y2 double"))
    assert D.largest(tracks, ["drone_id", "frame_no"]).first().det_id == 1
    box = spark.createDataFrame([("d", 1, 0, 0, 0, 1, 0.9, 10.6, 0.0, 21.6, 10.9, "car")], tracks.schema)
    row = D.follow(box).first()
    assert (row.cx, row.cy, row.area, row.reference_area) == (15, 5, 110, 110)


def test_limit_itself_is_kept_and_copies_collapse(spark):
    half = [(1, 0, 1, 0.9, 0, 0, 20, 10), (1, 1, 2, 0.8, 0, 0, 10, 10)]  # overlap exactly 0.5
    copies = [(2, i, 10 + i, 0.5, 0, 0, 10, 10) for i in range(5)]
    assert kept(spark, half + copies) == {1, 2, 10}


def test_chain_and_empty_boxes(spark):
    chain = [(1, 0, 1, 0.9, 0, 0, 30, 10), (1, 1, 2, 0.8, 8, 0, 38, 10), (1, 2, 3, 0.7, 16, 0, 46, 10)]
    empty = [(2, 0, 4, 0.9, 5, 5, 5, 5), (2, 1, 5, 0.8, 7, 7, 7, 7)]
    assert kept(spark, chain + empty) == {1, 3, 4}


TRACKS = "drone_id string, frame_no bigint, us bigint, det_idx bigint, det_id bigint, track_id bigint, conf double, " \
         "x1 bigint, y1 bigint, x2 bigint, y2 bigint, class_name string"


def track(frame, t, size, name="car", track_id=1, idx=0):
    return ("d", frame, int(t * 1e6), idx, frame * 10 + idx, track_id, 0.9, 0, 0, size, size, name)


@pytest.mark.parametrize("slice_us", [1_000_000, 10**12])
def test_states_and_reference_area(spark, slice_us):
    rows = [
        track(0, 0.0, 9, "van"), track(1, 0.5, 10), track(2, 1.0, 20), track(3, 2.9, 9, "van"), track(4, 3.0, 9, "van"),
        track(5, 3.5, 30), track(6, 5.4, 9, "van"), track(7, 5.5, 9, "van"), track(8, 6.0, 40), track(9, 20.0, 50),
    ]
    got = {r.frame_no: r for r in D.follow(spark.createDataFrame(rows, TRACKS), slice_us=slice_us).collect()}
    assert [got[i].state for i in range(10)] == [
        "searching", "following", "following", "lost", "searching", "following", "lost", "searching", "following", "following",
    ]
    assert [got[i].reference_area for i in (1, 2, 5, 8, 9)] == [100, 100, 900, 1600, 1600]


def test_lock_needs_a_held_target(spark):
    rows = []
    for frame, t in enumerate([0.0, 0.5, 1.0]):
        rows += [track(frame, t, 30, idx=0, track_id=1), track(frame, t, 10, idx=1, track_id=2)]
    rows.append(track(3, 1.5, 30, idx=0, track_id=1))
    got = {r.frame_no: r.track_id for r in D.follow(spark.createDataFrame(rows, TRACKS), locked_id=2).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 1}


def test_sortable_orders_every_double(spark):
    from fleetlens.functions.columns import finite, sortable

    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 0.5, 0.50000005, 2.0**-1000, 2.0**1000, 1.7e308, 4e12, float("inf"), float("-inf"), 3e-308]
    values += [2.0**k * (1 + d) for k in range(-60, 60, 7) for d in (0.0, 2.0**-52, 1 - 2.0**-52)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(500)]
    values += [-v for v in values] + [np.nextafter(v, 1e308) for v in values if abs(v) < 1e300]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [(r.v, r.k) for r in df.select("v", sortable("v").alias("k")).collect()]
    for (a, ka), (b, kb) in zip(sorted(got), sorted(got)[1:]):
        assert ka < kb if a != b and max(abs(a), abs(b)) > 2.3e-308 else ka <= kb, (a, b)
    odd = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (float("inf"),)], "v double")
    assert [tuple(r) for r in odd.select(sortable("v").isNull(), finite("v")).collect()] == [(True, False), (True, False), (False, True), (False, False)]


def test_larger_of_nearly_equal_boxes_and_very_large_ones(spark):
    schema = TRACKS.replace("x1 bigint, y1 bigint, x2 bigint, y2 bigint", "x1 double, y1 double, x2 double, y2 double")
    def box(frame, idx, w, h):
        return ("d", frame, 0, idx, frame * 1000 + idx, 1, 0.9, 0.0, 0.0, w, h, "car")
    rows = [box(1, 0, 0.5, 1.0), box(1, 100, 0.50000005, 1.0), box(2, 0, 5.0, 5.0), box(2, 1, 2e6, 2e6), box(2, 2, 2e6, 2e6), box(3, 0, 3.0, 3.0),
            box(3, 1, float("nan"), 9.0), box(3, 2, None, 9.0), box(3, 3, float("inf"), 9.0), box(4, 0, None, None)]
    got = {r.frame_no: r.det_id for r in D.largest(spark.createDataFrame(rows, schema), ["frame_no"]).collect()}
    assert got == {1: 1100, 2: 2001, 3: 3000, 4: None}


def test_a_malformed_box_does_not_empty_its_frame(spark):
    from fleetlens.sources import decode

    value = """{"drone_id": "d", "timestamp": 1, "detections": [{"track_id": 1, "confidence": 0.99, "bbox": [0, 0, 9]},
        {"track_id": 2, "confidence": 0.5, "bbox": [0, 0, 9, 9]}, {"track_id": 3, "confidence": 0.4, "bbox": [50, 50, 59, 59]},
        {"track_id": 4, "bbox": [70, 70, 79, 79]}]}"""
    good, bad = decode.decode_inference(spark.createDataFrame([(value,)], "value string"))
    boxes = decode.detection_table(good).withColumn("det_id", F.col("track_id"))
    assert bad.count() == 0 and {r.det_id for r in D.nms(boxes, ["drone_id", "us"]).collect()} == {2, 3}
    assert {r.det_id for r in D.malformed(boxes).collect()} == {1, 4}
