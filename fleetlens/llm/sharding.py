"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import quoted, whole_row, whole_text

#: Rows of a shard that one task numbers.
CHUNK_ROWS = 4096


def jump(key: Column, shards: int) -> Column:
    """The shard of a key among ``shards``: jump consistent hashing without a ring table.

    A key sits in bucket 0 and jumps ahead as buckets are added: from bucket ``b`` it next moves
    when the count reaches ``floor((b + 1) / u) + 1``, where the draw ``u`` in (0, 1] depends on the
    key and ``b`` alone. The last bucket below ``shards`` is its shard, so one more shard takes
    rows into itself only, a share of 1 / (shards + 1). The draws come from xxhash64 instead of a
    linear congruential generator, whose wrapping products are errors under ANSI arithmetic.
    A key of null has the hash of no input and a shard like any other.

    Each jump moves ahead by one bucket at least, so ``shards`` steps always suffice; for many
    shards a few steps nearly always do, and only keys that need more take the rest.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(state: Column, _: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, state["j"]), 33) + F.lit(1)
        ahead = F.floor((state["j"] + 1) * F.lit(2.0**31) / draw).cast("long")
        return F.when(state["j"] >= shards, state).otherwise(F.struct(state["j"].alias("b"), ahead.alias("j")))

    few = min(shards, 16 + 4 * math.ceil(math.log(shards + 1)))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    if few < shards:
        state = F.when(state["j"] >= shards, state).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step))
    return state["b"].cast("int")


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (the shard if there were one more): no shuffle.

    Nulls and repeated rows go by their key; an empty table stays empty; existing columns of
    these names are replaced.
    """
    stable = F.xxhash64(quoted(key))
    return docs.withColumns({"shard": jump(stable, shards), "grown_shard": jump(stable, shards + 1)})


def shard_slots(docs: DataFrame, shards: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Shard, size, checksum and a gapless slot within the shard, for every row of ``docs``.

    Only narrow columns are shuffled. A shard's rows are numbered in chunks by the hash of
    their id, and the chunks' counts give each chunk its first slot, so no task sorts a shard.
    Rows that agree in id, size and checksum are counted before the shuffle and spread out
    again after it, so a repeated row (or a third of the table with a null id) is no hot
    key. Null text counts as empty: size 8, checksum 0. Slots follow (chunk, id, size, checksum).
    """
    total = docs.count()
    chunks = max(1, math.ceil(total / (shards * chunk_rows)))
    stable = F.xxhash64(F.col("doc_id"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"shard": jump(stable, shards),
                               "chunk": F.pmod(F.xxhash64(F.col("doc_id"), F.lit("chunk")), F.lit(chunks))})

    narrow = docs.select(
        quoted("doc_id").alias("doc_id"),
        (F.octet_length(whole_text()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"))
    groups = placed(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")))
    # The scan for the chunks' counts reads the ids alone.
    ids = docs.select(quoted("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    counts = placed(ids).groupBy("shard", "chunk").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = (Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = groups.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(first, ["shard", "chunk"])
    slot = F.col("first") + F.col("at")
    spread = numbered.withColumn("grown_shard", jump(stable, shards + 1)).withColumn(
        "slot", F.explode(F.sequence(slot, slot + F.col("n") - 1)))
    return spread.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded_rows(docs: DataFrame, shards: int) -> DataFrame:
    """Whole rows next to their shard: ``(shard, row)``, ready for ``partitionBy('shard')`` writers."""
    return docs.select(jump(F.xxhash64(quoted("doc_id")), shards).alias("shard"), whole_row(docs).alias("row"))
