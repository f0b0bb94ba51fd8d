"""Follow state on a stream: restarts, timers, late frames, malformed boxes, against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import detections as D
from fleetlens.streaming import following, jobs

pytestmark = pytest.mark.usefixtures("few_partitions")

S = 1_000_000
TRACKS = ("drone_id string, frame_no bigint, us bigint, det_idx bigint, det_id bigint, track_id bigint, conf double, x1 double, y1 double, "
          "x2 double, y2 double, class_name string")
COLUMNS = ["drone_id", "frame_no", "us", "state", "det_id", "track_id", "area", "reference_area", "error_x", "error_y", "error_distance"]


def track(frame, t, size, name="car", track_id=1, idx=0, drone="d"):
    return (drone, frame, int(t * S), idx, frame * 10 + idx, track_id, 0.9, 0.0, 0.0, size, size, name)


def feed(spark, tmp_path, batches, **how):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    jobs.use_rocksdb(spark)
    box = F.struct("det_idx", "det_id", "track_id", "class_name", "conf", *D.BOX)
    for rows in batches:
        frames = spark.createDataFrame(rows, TRACKS).groupBy("drone_id", "frame_no", "us").agg(F.collect_list(box).alias("boxes"))
        frames.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frames.schema).parquet(folder).withColumn("ts", F.timestamp_micros("us"))
        jobs.run_append(following.follow_stream(stream, **how), out, state, availableNow=True).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("locked_id", [2])
def test_equals_the_batch_form(spark, tmp_path, locked_id):
    rng = random.Random(8)
    rows, t = [], 1.0
    for frame in range(160):
        t += rng.choice([0.1, 0.4, 0.9, 2.5])
        for idx in range(rng.randint(1, 3)):
            size = rng.choice([10.0, 12.5, 12.5, 30.25, float("nan")])
            rows.append(track(frame, t, size, rng.choice(["car", "van", "van"]), rng.choice([1, 2]), idx, rng.choice(["a"] if frame % 3 else ["b"])))
    cuts = [0, 50, 51, 160]
    batches = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, cuts[1:])]
    got = feed(spark, tmp_path, batches, locked_id=locked_id).filter("frame_no is not null")
    want = D.follow(spark.createDataFrame(rows, TRACKS), locked_id=locked_id)
    def of(df):
        return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)
    assert of(got) == of(want) and {r[3] for r in of(want)} == {"following", "lost", "searching"}


def test_a_lost_target_is_given_up_without_a_frame(spark, tmp_path):
    batches = [[track(1, 1.0, 10.0), track(2, 2.0, 9.0, "van"), track(1, 1.0, 10.0, drone="e")], [track(1, 9.0, 9.0, "van", drone="z")],
               [track(3, 8.5, 20.0), track(9, 1.5, 99.0, drone="e")], [track(2, 20.0, 9.0, "van", drone="z")], [track(3, 30.0, 9.0, "van", drone="z")]]
    got = {(r.drone_id, r.frame_no, r.us, r.state) for r in feed(spark, tmp_path, batches).collect()}
    assert {("d", 1, S, "following"), ("d", 2, 2 * S, "lost"), ("d", None, 3 * S, "searching"), ("e", None, 3 * S, "searching"),
            ("d", 3, int(8.5 * S), "following"), ("d", None, int(10.5 * S), "searching")} <= got
    assert sum(f is None and d == "d" for d, f, _, _ in got) == 2 and all(f != 9 for _, f, _, _ in got)  # 1.5 s is behind the watermark


def test_late_frames_change_nothing(spark, tmp_path):
    batches = [[track(1, 5.0, 10.0), track(2, 5.2, 12.0)], [track(7, 5.1, 50.0), track(3, 5.4, 14.0)]]
    got = {r.frame_no: (r.state, r.reference_area) for r in feed(spark, tmp_path, batches, delay="10 seconds").collect()}
    assert got == {1: ("following", 100), 2: ("following", 100), 7: ("late", None), 3: ("following", 100)}
