"""Current values folded into snapshots; sketches of quantiles."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import fleet
from fleetlens.streaming import snapshots

pytestmark = pytest.mark.usefixtures("few_partitions")

SCHEMA = "k string, a bigint, b string, us bigint"


def files_below(path):
    return sum(len(files) for _, _, files in os.walk(path))


def test_reading_stays_bounded_over_many_batches(spark, tmp_path):
    target, rng, want = str(tmp_path / "t"), random.Random(3), {}
    write = snapshots.keeping_current(target, ["k"], every=5)
    read = []
    for batch in range(22):
        rows = [(f"k{rng.randrange(12)}", batch, rng.choice([None, "x", "y"]), batch) for _ in range(3)]
        rows = list({r[0]: r for r in rows}.values())
        write(spark.createDataFrame(rows, SCHEMA).coalesce(1), batch)
        for k, a, b, _ in rows:
            want[k] = (a, b if b is not None else want.get(k, (0, None))[1])
        if batch % 7 == 6:
            now = snapshots.current(spark, target, ["k"])
            read.append(snapshots.read_files(now))
            assert {r.k: (r.a, r.b) for r in now.collect()} == want
    assert max(read) <= 12 + 5 and len(os.listdir(f"{target}/changes")) <= 12 and len(os.listdir(f"{target}/snapshots")) == 2


def test_a_batch_that_is_repeated_or_unfinished_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    write = snapshots.keeping_current(target, ["k"], every=2)
    frames = [spark.createDataFrame([("k", i, str(i), i)], SCHEMA) for i in range(5)]
    for i, df in enumerate(frames):
        write(df, i)
    for i in (3, 4):  # the last fold and the batch after it once more, as after a failure
        write(frames[i], i)
    os.makedirs(f"{target}/changes/batch_id=5")
    open(f"{target}/changes/batch_id=5/part-0.parquet", "w").close()  # half written
    assert [(r.a, r.batch_id) for r in snapshots.current(spark, target, ["k"]).collect()] == [(4, 4)]
    assert [r.a for r in snapshots.current(spark, target, ["k"], upto=3).collect()] == [3]
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, str(tmp_path / "none"), ["k"])


def test_old_keys_go(spark, tmp_path):
    target = str(tmp_path / "t")
    write = snapshots.keeping_current(target, ["k"], every=2, keep_s=10)
    for i, (k, us) in enumerate([("a", 0), ("b", 5_000_000), ("c", 12_000_000), ("d", 15_000_001)]):
        write(spark.createDataFrame([(k, i, "x", us)], SCHEMA), i)
    assert {r.k for r in snapshots.current(spark, target, ["k"], keep_s=10).collect()} == {"c", "d"}
    assert {r.k for r in spark.read.parquet(f"{target}/snapshots/upto=3").collect()} == {"c", "d"}


@pytest.mark.parametrize("accuracy", [100, 1000])
def test_merged_sketches_keep_their_rank_error(spark, accuracy):
    n = 120_000
    df = spark.range(n).select((F.col("id") % 7).alias("drone"), (F.col("id") * 1000).alias("us"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    odd = spark.createDataFrame([(1, 5, float("nan")), (1, 5, None), (1, None, 3.0)], "drone bigint, us bigint, v double")
    sketches = fleet.quantile_sketches(df.unionByName(odd), "v", ["drone"], 10.0, accuracy)
    assert sketches.count() == 7 * 12 and sketches.agg(F.sum("n")).first()[0] == n
    found = fleet.merged_quantiles(sketches, at=(0.01, 0.5, 0.95)).first()
    for q, name in ((0.01, "p1"), (0.5, "p50"), (0.95, "p95")):
        assert abs(found[name] / n - q) <= 1 / accuracy + 1 / n
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 200 * accuracy
    assert fleet.merged_quantiles(sketches.limit(0), ["drone"]).count() == 0
