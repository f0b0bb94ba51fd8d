"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import count_words, quoted, row_key, whole_row, whole_text
from fleetlens.session import written

#: Units that one flight takes. Each flight leaves two undecided at most.
FLIGHT_UNITS = 2000
SEED = 20240


def targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """Target per source from ``(source, source_size, units)``, one row per source.

    Sources by code point, null last, take ``weights`` in turn, repeating. Together they get
    ``share`` of all sizes; a target stops at ``ceiling`` times its source's size and the excess
    goes to the others by weight. That is one level: every source gets weight x level, or its
    ceiling where that is less, so the level follows from running sums over the sources in the
    order in which they reach their ceilings. The window is over one row per source.
    A source without words has the target 0.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
    weighted = placed.withColumns({
        "weight": F.element_at(turn, F.col("turn") + 1),
        "most": F.lit(float(ceiling)) * F.col("source_size"),
        "pool": F.lit(float(share)) * F.sum("source_size").over(everything)})
    # Those that fill first come first; before a source stand the ceilings of all that fill earlier.
    filling = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighted.withColumn(
        "level", (F.col("pool") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source that its level does not fill sets the level of all after it.
    opened = levels.withColumn("open", F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return opened.select("source", "source_size", "units", F.coalesce(F.least(F.col("most"), level * F.col("weight")),
                                                                      F.col("most")).alias("target"))


def _flight(chance: np.ndarray, size: np.ndarray, draws: np.ndarray, land: bool) -> np.ndarray:
    """Move chances to 0 or 1 within the null space of (number, total size), in place.

    Largest first: the unit's own axis, projected on the null space, is a direction along which the
    unit moves and all open units make up for it a little, so that the sum of the chances and
    the sum of chance x size stay. A step along it, either way with the odds that keep every
    chance's expectation, decides at least one unit. One or two open units are left, mostly
    small ones: the landing problem. ``land`` solves it by the rounding, among those that keep
    each chance, whose expected error in size is least.
    """
    p, s = chance, size.astype(float)
    p[p <= 1e-9] = 0.0
    p[p >= 1 - 1e-9] = 1.0
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-s[open_], kind="stable")]
    at = 0
    while len(open_) > 1:
        own = s[open_] - s[open_].mean()
        spread = float(own @ own)
        u = np.full(len(open_), -1.0 / len(open_))
        if spread > 0:
            u -= own[0] / spread * own
        u[0] += 1
        u[np.abs(u) < 1e-12] = 0.0
        if not u.any():
            if len(open_) == 2:
                break
            open_ = np.roll(open_, -1)  # a unit that nothing can make up for waits
            continue
        moving = np.flatnonzero(u)
        now, v = p[open_[moving]], u[moving]
        ahead, behind = np.where(v > 0, 1 - now, now), np.where(v > 0, now, 1 - now)
        up, down = float((ahead / np.abs(v)).min()), float((behind / np.abs(v)).min())
        now = now + (up if draws[at] * (up + down) < down else -down) * v
        at += 1
        now[now <= 1e-9] = 0.0
        now[now >= 1 - 1e-9] = 1.0
        p[open_[moving]] = now
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    if land and len(open_) == 1:
        p[open_] = float(draws[-1] < p[open_[0]])
    elif land and len(open_) == 2:
        (a, b), draw = open_, draws[-1]

        def cost(x: int, y: int) -> float:
            return ((x - p[a]) * s[a] + (y - p[b]) * s[b]) ** 2

        together = cost(1, 1) - cost(1, 0) - cost(0, 1) + cost(0, 0) < 0
        both = min(p[a], p[b]) if together else max(0.0, p[a] + p[b] - 1)
        p[a], p[b] = float(draw < p[a]), float(draw < both or p[a] <= draw < p[a] + p[b] - both)
    return p


def _fly(key: tuple, units: pa.Table) -> pa.Table:
    """One flight over a block; the last key field is the number of blocks its source has."""
    column = {name: units[name].to_numpy() for name in ("hash", "size", "n", "whole", "chance")}
    order = np.lexsort((column["n"], column["size"], column["hash"]))
    column = {name: values[order] for name, values in column.items()}
    seed = np.random.SeedSequence([SEED, *(column["hash"][:4].astype(np.int64) & 0xFFFFFFFF).tolist()])
    draws = np.random.Generator(np.random.PCG64(seed)).random(2 * len(order) + 8)
    chance = _flight(column["chance"].copy(), column["size"], draws, land=key[2].as_py() <= 1)
    decided = (chance == 0) | (chance == 1)
    whole = column["whole"] + np.where(decided, chance, 0).astype(np.int64)
    out = units.take(pa.array(order))
    for name, values in (("whole", whole), ("chance", np.where(decided, -1.0, chance))):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
    return out.select(_LEVEL)


_LEVEL = ["doc_id", "source", "size", "source_size", "target", "row_a", "row_b", "n", "whole", "hash", "chance"]


def decide(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0,
    flight_units: int = FLIGHT_UNITS,
) -> DataFrame:
    """How often the mix takes each document of ``docs``.

    A unit is a set of rows that agree in every column; it stands for ``n`` rows and gets ``copies``
    in all. With m = target / source size, n x m copies are due: the whole part for certain, the
    rest as the chance of one more. Chances are decided by cube flights that keep, per source, the
    number of documents and their total size. A flight takes a bounded block of a source's units,
    by hash, so a hot source is many flights; the one or two that each leaves undecided fly again
    together, level by level, until a source has one block, which lands. Every level is written to
    the shared folder.

    Returns ``(doc_id, source, size, source_size, target, row, n, copies)``. Null text has size 0, a
    null source is a source, null ids are ids; an empty table gives no rows. Results depend on
    the rows alone, not on their order or partitioning.
    """
    narrow = docs.select(
        quoted("doc_id").alias("doc_id"), quoted("source").cast("string").alias("source"),
        count_words(whole_text()).alias("size"), row_key(docs).alias("row"))
    units = written(narrow.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                        F.count("*").alias("units"))
    aims = written(targets(sizes, weights, share, ceiling), "mix-targets")
    due = F.when(F.col("source_size") > 0, F.col("n") * (F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    held = units.alias("u").join(aims.alias("a"), F.col("u.source").eqNullSafe(F.col("a.source"))).select(
        "u.doc_id", "u.source", "u.size", "a.source_size", "a.target", F.col("u.row.a").alias("row_a"),
        F.col("u.row.b").alias("row_b"), "u.n", "a.units", F.xxhash64(F.col("u.row"), F.lit(SEED)).alias("hash"),
        due.alias("due"))
    flying = held.select("*", F.floor(F.col("due") + 1e-9).alias("whole")).withColumn(
        "chance", F.greatest(F.col("due") - F.col("whole"), F.lit(0.0))).drop("due")

    schema = ", ".join(f"{name} {flying.schema[name].dataType.simpleString()}" for name in _LEVEL)
    blocks = F.ceil(F.col("units") / flight_units)
    levels = []
    while True:
        # A source in one block lands; what the others leave undecided flies again.
        flights = flying.select(*_LEVEL, blocks.alias("blocks"), F.pmod("hash", blocks).alias("block"))
        level = written(flights.groupBy("source", "block", "blocks").applyInArrow(_fly, schema), "mix-level")
        levels.append(level.where("chance < 0"))
        rest = level.where("chance >= 0")
        if rest.isEmpty():
            break
        left = rest.groupBy("source").agg(F.count("*").alias("units"))
        flying = rest.alias("r").join(left.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source"))).select(
            "r.*", "l.units")
    return reduce(DataFrame.unionByName, levels).select(
        "doc_id", "source", "size", "source_size", "target", F.struct(
            F.col("row_a").alias("a"), F.col("row_b").alias("b")).alias("row"), "n", F.col("whole").alias("copies"))


def copies_of(copies: Column, n: Column, i: Column) -> Column:
    """Of ``copies`` of a unit of ``n`` rows, those of its row ``i``: as even as whole numbers allow."""
    return F.floor(copies / n) + F.when(i < copies % n, 1).otherwise(0)


def taken(decisions: DataFrame) -> DataFrame:
    """One row per document with the words that the mix takes of it, repeats counted."""
    rows = decisions.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * copies_of(F.col("copies"), F.col("n"), F.col("i"))).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed to the target weights: each row as often as ``decide`` takes it.

    Rows that agree in every column are interchangeable; one of them is repeated. Decisions and
    rows meet in one aggregation by row key, whose partial step merges repeated rows before the
    shuffle, so neither a hot source nor a row repeated many times is one task's work.
    """
    decisions = decide(docs, **options)
    row = whole_row(docs)
    rows = docs.select(row_key(docs).alias("key"), row.alias("row"), F.lit(None).cast("long").alias("copies"))
    marks = decisions.where("copies > 0").select(
        F.col("row").alias("key"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "copies")
    met = rows.unionByName(marks).groupBy("key").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("copies").alias("copies")).where("copies > 0")
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
