"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import giving_back, quoted, row_key, whole_row, whole_text
from fleetlens.llm.components import components
from fleetlens.session import written

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints that share a variant and are compared pair by pair; more are indexed again by finer variants.
RUN = 4096
#: Linked pairs that a task holds before it folds them into stars.
HELD_PAIRS = 500_000
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# Fingerprints

def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every ``words``-word shingle of a text, A-Z in lower case, repeats included.

    A text of fewer words is one shingle, one without words has none. Blocks bound the memory.
    """
    carry: list[bytes] = []
    digest, seen, at = xxhash.xxh64_intdigest, False, 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        found = carry + text[at:end].lower().split()
        at = end
        if len(found) < words:
            carry = found
            continue
        joined = b" ".join(found)
        starts = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=starts[1:])
        ends = (starts[words:] - 1).tolist()
        yield np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))
        seen, carry = True, found[len(found) - words + 1:]
    if not seen and carry:
        yield np.array([digest(b" ".join(carry), 42)], dtype=np.uint64)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in over half the shingles' hashes; no words: zero."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, words):
        total += len(hashes)
        for part in np.array_split(hashes, len(hashes) // 4096 + 1):
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, a, b, fp)``: every row's id, row key and fingerprint as a signed 64-bit number."""
    narrow = docs.select(quoted("doc_id").alias("doc_id"), row_key(docs).alias("key"),
                         whole_text().cast("binary").alias("text")).select("doc_id", "key.a", "key.b", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))],
                                             ["doc_id", "a", "b", "fp"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(giving_back(run), f"doc_id {kind}, a long, b long, fp long")


# Links

def _canonical(x: np.ndarray) -> np.ndarray:
    """Of the variants that two fingerprints with xor ``x`` share, the one that accounts for the pair."""
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    first = np.bitwise_count(low) <= 1
    half = np.where(first, low, high)
    return np.where(first, 0, 32) + np.where(half > 0, np.bitwise_count(half - np.uint64(1) * (half > 0)), 0)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``n`` rows as stars around the first row of each connected set: one edge a row at most."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        if (ra == rb).all():
            break
        least = np.minimum(ra, rb)
        np.minimum.at(parent, ra, least)
        np.minimum.at(parent, rb, least)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    rows = np.flatnonzero(parent != np.arange(n))
    return rows, parent[rows]


def _link_runs(most: int, max_bits: int, keys: int):
    """Compare fingerprints within runs of equal keys; a run of over ``most`` is passed on as it is.

    Input is sorted by its first ``keys`` columns, the key first; the last column is the fingerprint.
    Output ``(hot, x, y)``: an edge, or with ``hot`` a row (key, fingerprint) of a run passed on.
    Memory is bounded by a batch and a run of ``most``.
    """
    def links(key: np.ndarray, end: np.ndarray, fp: np.ndarray):
        """end: where each row's run ends."""
        found, held, at, step = [], 0, np.arange(len(fp)), 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            x = (fp[at] ^ fp[at + step]).astype(np.uint64)
            near = np.bitwise_count(x) <= max_bits
            near[near] = _canonical(x[near]) == ((key[at[near]] >> 32) & 63)
            if near.any():
                found.append((at[near], at[near] + step))
                held += len(found[-1][0])
                if held > HELD_PAIRS:
                    found, held = [_stars(len(fp), *map(np.concatenate, zip(*found)))], 0
            step += 1
        if not found:
            return None
        rows, roots = _stars(len(fp), *map(np.concatenate, zip(*found)))
        return fp[rows], fp[roots]

    def rows(hot: bool, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(x), hot)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], ["hot", "x", "y"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None  # the open run's rows; the key of an open run that is passed on
        for last, batch in _with_last(batches):
            part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held is not None:
                part = np.concatenate([held, part], axis=1)
            if passing is not None:
                other = np.flatnonzero((part[:keys] != passing[:, None]).any(axis=0))
                cut = other[0] if len(other) else part.shape[1]
                yield rows(True, part[0, :cut], part[-1, :cut])
                part, passing = part[:, cut:], (passing if cut == part.shape[1] else None)
            if not part.shape[1]:
                held = None
                continue
            changed = (part[:keys, 1:] != part[:keys, :-1]).any(axis=0)
            starts = np.concatenate(([0], np.flatnonzero(changed) + 1))
            ends = np.append(starts[1:], part.shape[1])
            if last:
                held = None
            else:
                held, starts, ends = part[:, starts[-1]:], starts[:-1], ends[:-1]
                if held.shape[1] > most:
                    yield rows(True, held[0], held[-1])
                    held, passing = None, held[:keys, 0].copy()
            length = ends - starts
            if (length > most).any():
                hot = np.concatenate([np.arange(s, e) for s, e in zip(starts[length > most], ends[length > most])])
                yield rows(True, part[0, hot], part[-1, hot])
            small = (length > 1) & (length <= most)
            if small.any():
                size = length[small]
                new = np.concatenate(([0], np.cumsum(size)))
                row = np.repeat(starts[small] - new[:-1], size) + np.arange(new[-1])
                edges = links(part[0, row], np.repeat(new[1:], size), part[-1, row])
                if edges is not None:
                    yield rows(False, *edges)

    return run


def _with_last(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield False, before
            before = batch
    if before is not None:
        yield True, before


def _runs(variants: DataFrame, most: int, max_bits: int) -> DataFrame:
    keys = variants.columns[:-1]
    near = variants.repartition(*keys).sortWithinPartitions(*variants.columns)
    return near.mapInArrow(giving_back(_link_runs(most, max_bits, len(keys))), "hot boolean, x long, y long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fps (fp)`` as their links do.

    Of two 32-bit segments one differs by one bit at most if ``max_bits`` <= 3 bits differ, so the two
    fingerprints share that segment with one of its bits wiped out. Each fingerprint is indexed
    under its 2 x 32 such variants; equal variants meet, and pairs are verified. A variant that more
    than ``run`` fingerprints share is split by variants of the other segment's halves (16 bits
    each), and where need be of the quarters that remain (8 bits), by the same argument. Below that
    only 11 bits are free, so at most 2,048 fingerprints can meet: no group grows with the data.
    Within a run links become stars, never all pairs.
    """
    if max_bits > 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    wide = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    # Bits 0-31: the segment without bit v % 32; bits 32-37: v.
    first = wide.selectExpr(
        "(CASE WHEN v < 32 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END & ~shiftleft(1L, v % 32))"
        " | shiftleft(CAST(v AS BIGINT), 32) AS key", "fp")
    level1 = written(_runs(first, run, max_bits), "simhash-links")
    # The other segment's half h without bit i: bits 38-42 hold (h, i), bits 43-58 the half.
    half = level1.where("hot").selectExpr("x AS key", "y AS fp", "explode(sequence(0, 31)) AS w").selectExpr(
        "key", "fp", "w", "shiftrightunsigned(fp, CASE WHEN (shiftrightunsigned(key, 32) & 63) < 32 THEN 32 ELSE 0 END"
        " + 16 * shiftright(w, 4)) & 65535 AS half")
    second = half.selectExpr("key | shiftleft(CAST(w AS BIGINT), 38) | shiftleft(half & ~shiftleft(1L, w % 16), 43) AS key",
                             "fp")
    level2 = written(_runs(second, run, max_bits), "simhash-links")
    # What is left is the half that bit 42 does not name; its quarters of 8 bits.
    quarter = level2.where("hot").selectExpr("x AS key", "y AS fp", "explode(sequence(0, 15)) AS w").selectExpr(
        "key", "w", "fp", "shiftrightunsigned(fp, CASE WHEN (shiftrightunsigned(key, 32) & 63) < 32 THEN 32 ELSE 0 END"
        " + CASE WHEN (shiftrightunsigned(key, 42) & 1) = 0 THEN 16 ELSE 0 END + 8 * shiftright(w, 3)) & 255 AS quarter")
    third = quarter.selectExpr("key", "CAST(w AS BIGINT) * 256 + (quarter & ~shiftleft(1L, w % 8)) AS sub", "fp")
    level3 = _runs(third, max(run, 1 << 12), max_bits)
    edges = level1.where("NOT hot").unionByName(level2.where("NOT hot")).unionByName(level3.where("NOT hot"))
    return edges.select(F.col("x").alias("a"), F.col("y").alias("b"))


def clusters(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, a, b, fp, root, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, null only where all of a component's ids
    are; ``root`` names the component. Texts that are null, empty or without words have the
    fingerprint zero and are linked like any other. Equal fingerprints are one node, so copies are
    never compared with one another. Repeated rows have one result each; an empty table none.
    """
    own = written(fingerprints(docs, words), "simhash-fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.drop("first").join(least, "root")
    return own.join(named, "fp").select("doc_id", "a", "b", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, then the smallest row key.

    Null ids come last. Rows that agree in every column are one. Rows and choices meet in
    one aggregation by row key, whose partial step merges repeated rows before the shuffle.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "a", "b")
    chosen = clusters(docs, words, max_bits).groupBy("root").agg(F.min(rank).alias("best"))
    rows = docs.select(row_key(docs).alias("key"), whole_row(docs).alias("row"), F.lit(False).alias("kept"))
    marks = chosen.select(F.struct(F.col("best.a").alias("a"), F.col("best.b").alias("b")).alias("key"),
                          F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(True).alias("kept"))
    met = rows.unionByName(marks).groupBy("key").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("kept").alias("kept"))
    return met.where("kept").select("row.*")
