"""As-of join of two streams against the batch form; versions of a lookup."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import commands, lookups
from fleetlens.streaming import jobs, joins

pytestmark = pytest.mark.usefixtures("few_partitions")

S = 1_000_000
LEFT = "event_id bigint, drone_id string, us bigint, command string, at timestamp, share double"
RIGHT = "event_id bigint, drone_id string, us bigint, note string"


def feed(spark, tmp_path, batches):
    folders = [str(tmp_path / n) for n in ("left", "right")]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    jobs.use_rocksdb(spark)
    for batch in batches:
        for folder, rows, schema in zip(folders, batch, (LEFT, RIGHT)):
            df = spark.createDataFrame(rows, schema)
            if "at timestamp" in schema:
                df = df.withColumns({"at": F.timestamp_micros(F.col("us") + 7), "share": F.col("event_id") / 3})
            df.write.mode("append").parquet(folder)
        left, right = (spark.readStream.schema(s).parquet(f).withColumn("ts", F.timestamp_micros("us")) for f, s in zip(folders, (LEFT, RIGHT)))
        matched = joins.asof_stream(left, right, ["drone_id"], ["us", "event_id", "note"]).drop("ts")
        jobs.run_append(matched, out, state, availableNow=True).awaitTermination()
    return spark.read.parquet(out)


def test_equals_the_batch_join_with_late_rows_and_ties(spark, tmp_path):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", "c"]), rng.randrange(1, 200) * S, rng.choice(["go", None]), None, None) for i in range(120)]
    right = [(1000 + i, rng.choice(["a", "a", "b"]), rng.randrange(1, 200) * S, rng.choice(["x", None])) for i in range(300)]
    left += [(500, None, 50 * S, "go", None, None), (501, "a", None, "go", None, None)]
    right += [(2000, None, 49 * S, "null drone")]
    batches = []
    for start in range(0, 200, 50):  # right rows come up to three seconds later than their time
        def of(rows, lag):
            return [r for r in rows if r[2] is not None and start - lag <= r[2] / S < start + 50 - lag] + (
                [r for r in rows if r[2] is None] if start == 50 else [])
        batches.append((of(left, 0), of(right, 3)))
    batches[-1] = (batches[-1][0], [r for r in right if r[2] >= 147 * S])
    batches.append(([], [(9999, "zz", 210 * S, "closing")]))
    got = feed(spark, tmp_path, batches)
    kept = spark.createDataFrame([r for r in left if r[2] is not None], LEFT).withColumns(
        {"at": F.timestamp_micros(F.col("us") + 7), "share": F.col("event_id") / 3})
    want = commands.asof_join(kept, spark.createDataFrame(right, RIGHT), ["drone_id"], ["us", "event_id", "note"])
    columns = ["event_id", "drone_id", "us", "command", "at", "share", "match.us", "match.note"]

    def rows(df):
        return sorted((tuple(r) for r in df.select(columns).collect()), key=str)

    # Of right rows at one time any may match: the batch form takes the largest id.
    assert rows(got) == rows(want) and len(rows(got)) == 121
    same = sorted((r.event_id, r.match.event_id) for r in got.filter("match is not null").collect())
    assert same == sorted((r.event_id, r.match.event_id) for r in want.filter("match is not null").collect())


def test_a_command_goes_out_although_its_drone_falls_silent(spark, tmp_path):
    batches = [([(1, "a", 10 * S, "go", None, None)], [(2, "a", 9 * S, "x")]), ([], [(3, "b", 40 * S, "y")]), ([(4, "c", 50 * S, "go", None, None)], [])]
    got = {(r.event_id, r.match and r.match.event_id) for r in feed(spark, tmp_path, batches).collect()}
    assert (1, 2) in got and all(e != 4 for e, _ in got)  # the last one still waits for time to pass


def test_versions_by_time(spark):
    versions = spark.createDataFrame([("f", 10, 1), ("f", 20, 2), ("f", 20, 3), ("g", 5, 9), (None, 0, 7), ("f", None, 4)], "mode string, valid_from bigint, size int")
    rows = spark.createDataFrame([(1, "f", 9), (2, "f", 10), (3, "f", 19), (4, "f", 20), (5, "g", 99), (6, "h", 99), (7, None, 1), (8, "f", None)],
                                 "id int, mode string, us bigint")
    got = {r.id: r.config and r.config["size"] for r in lookups.with_version(rows, versions, "mode", ["size"]).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 3, 5: 9, 6: None, 7: 7, 8: None}
    assert lookups.with_version(rows, versions.limit(0), "mode", ["size"]).count() == 8
