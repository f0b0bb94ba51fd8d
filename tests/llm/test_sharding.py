import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from fleetlens.llm import sharding


def test_slots_sizes_and_sums(docs):
    rows = sharding.shard_slots(docs, 24, chunk_rows=2).collect()
    plain = {d["doc_id"]: d["text"].encode() for d in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len(plain[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(plain[r["doc_id"]])
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(plain) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(24)) and {r["law"] for r in rows} == {"key"}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    for n in (1, 2, 23, 24, 200):
        rows = sharding.with_shard(ids, n)
        moved = rows.where("shard <> grown_shard").collect()
        assert all(r["grown_shard"] == n for r in moved)
        assert abs(len(moved) - 20_000 / (n + 1)) < 6 * (20_000 / (n + 1)) ** 0.5
        again = rows.select("doc_id", "grown_shard").exceptAll(
            ids.select("doc_id", sharding.jump(F.xxhash64("doc_id"), n + 1).alias("grown_shard")))
        assert again.isEmpty()


def test_shards_are_even(spark):
    counts = [r["count"] for r in sharding.with_shard(spark.range(48_000).withColumnRenamed("id", "doc_id"), 24)
              .groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) < 2300 and min(counts) > 1700


def test_few_steps_fall_back_to_all(spark):
    """Keys that need more than the usual steps are carried on: compare with a loop over draws."""
    n, rows = 300, sharding.with_shard(spark.range(300).withColumnRenamed("id", "doc_id"), 300).collect()
    draws = {(r["k"], r["j"]): r["d"] for r in spark.range(300).select(
        F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("j")).select(
        "k", "j", F.shiftrightunsigned(F.xxhash64(F.xxhash64("k"), "j"), 33).alias("d")).collect()}
    for r in rows:
        b, j = -1, 0
        while j < n:
            b, j = j, int((j + 1) * (2.0**31 / (draws[r["doc_id"], j] + 1)))
        assert r["shard"] == b


def test_odd_tables(odd_docs, no_docs, clashing_docs):
    for table in (odd_docs, clashing_docs):
        rows = sharding.shard_slots(table, 3, chunk_rows=1).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert len(rows) == table.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert (8, 0) in {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1}
    assert sharding.shard_slots(no_docs, 24).collect() == []
    assert sharding.sharded_rows(clashing_docs, 3).count() == clashing_docs.count()


def test_no_python_in_the_plan(docs):
    plan = sharding.shard_slots(docs, 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
