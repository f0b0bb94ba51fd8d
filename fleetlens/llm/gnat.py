"""Vector codes: integer vectors in parts, each replaced by the nearest entry of its codebook.

The entries of a codebook stand in a geometric near-neighbour access tree (GNAT). A node holds a few split
points; every other entry belongs to its nearest split point, and for each pair (split point, child) the
node stores the range of distances between them. A query's distance to one split point then rules out
every child whose range it cannot reach. All distances are whole numbers: squares are exact, their roots
are rounded away from a wrong elimination, and only a strict gap eliminates, so ties reach their test.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import giving_back, quoted, whole_row
from fleetlens.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node; a node of no more entries has no children.
SPLITS = 4
#: Whole numbers are held within this bound either way, so that sums over any table fit 38 digits.
BOUND = 10**27
#: Rows compared at a time.
BLOCK = 4096
LARGEST = (1 << 63) - 1

_NUMBER = pa.decimal128(38, 0)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers next to the roots of ``squares``, below and above; both the root where it is whole."""
    if squares.dtype == object:
        low = np.frompyfunc(math.isqrt, 1, 1)(squares)
    else:
        low = np.sqrt(squares.astype(np.float64)).astype(np.int64)  # may be one off for large squares
        low -= low * low > squares
        low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = x - entry
    return (apart * apart).sum(axis=1)


class Node(NamedTuple):
    splits: list[int]
    #: ``low[i][j]``, ``high[i][j]``: bounds of the distances from split point i to split point j and all below it.
    low: list[list[int]]
    high: list[list[int]]
    children: list[Node | None]


def grow(entries: np.ndarray, among: list[int] | None = None) -> Node:
    """The tree over ``among``, indices of ``entries``; split points are far from each other."""
    among = list(range(len(entries))) if among is None else among
    splits = among[:1]
    near = squared(entries[among], entries[among[0]])
    home = np.zeros(len(among), dtype=np.int64)
    while len(splits) < min(SPLITS, len(among)):
        near[[among.index(s) for s in splits]] = -1
        far = int(np.argmax(near))
        own = squared(entries[among], entries[among[far]])
        closer = own < near
        home[closer], near[closer] = len(splits), own[closer]
        splits.append(among[far])
    below = [[e for e, h in zip(among, home) if h == j and e not in splits] for j in range(len(splits))]
    low, high = [], []
    for s in splits:
        ranges = [roots(squared(entries[[t, *rest]], entries[s])) for t, rest in zip(splits, below)]
        low.append([int(under.min()) for under, _ in ranges])
        high.append([int(over.max()) for _, over in ranges])
    return Node(splits, low, high, [grow(entries, rest) if rest else None for rest in below])


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` its nearest entry (the first of equally near ones), the squared distance, and how
    many distances were worked out in all."""
    best = np.full(len(x), -1, dtype=np.int64)
    apart = np.full(len(x), -1, dtype=entries.dtype)
    worked = _descend(tree, entries, x, np.arange(len(x)), best, apart)
    return best, apart, worked


def _descend(node: Node, entries: np.ndarray, x: np.ndarray, rows: np.ndarray, best: np.ndarray, apart: np.ndarray) -> int:
    """Meet the split points one after another, each only by rows that no earlier one has ruled it out for."""
    alive = np.ones((len(rows), len(node.splits)), dtype=bool)
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    worked = 0

    def rule_out(i: int) -> None:
        at, under, over = seen[i]
        reach = roots(apart[rows[at]])[1]
        for j in range(len(node.splits)):
            gone = (under - reach > node.high[i][j]) | (over + reach < node.low[i][j])
            alive[at[gone.astype(bool)], j] = False

    for i, split in enumerate(node.splits):
        at = np.flatnonzero(alive[:, i])
        mine = rows[at]
        found = squared(x[mine], entries[split])
        worked += len(mine)
        better = (best[mine] < 0) | (found < apart[mine]) | ((found == apart[mine]) & (split < best[mine]))
        best[mine[better]], apart[mine[better]] = split, found[better]
        seen.append((at, *roots(found)))
        rule_out(i)
    for j, child in enumerate(node.children):
        if child is not None:
            for i in range(len(node.splits)):  # what is best may have come nearer since
                rule_out(i)
            at = np.flatnonzero(alive[:, j])
            if len(at):
                worked += _descend(child, entries, x, rows[at], best, apart)
    return worked


class Codebooks:
    """Entries by part, and how vectors become whole numbers.

    ``entries`` is (parts, entries, width). ``exact`` says that all squares fit 64 bits; otherwise numbers are
    Python's, of any size.
    """

    def __init__(self, entries: np.ndarray, scale: int, exact: bool) -> None:
        self.entries, self.scale, self.exact = entries.astype(np.int64 if exact else object), scale, exact

    def __getstate__(self) -> tuple:
        return self.entries.tolist(), self.entries.shape, self.scale, self.exact

    def __setstate__(self, state: tuple) -> None:
        flat, shape, scale, exact = state
        self.__init__(np.array(flat, dtype=object).reshape(shape), scale, exact)

    def trees(self) -> list[Node]:
        return [grow(part) for part in self.entries]

    def parts_of(self, vectors: pa.Array) -> np.ndarray:
        """``(rows, parts, width)`` of whole numbers; shorter vectors are filled up with zeros."""
        parts, _, width = self.entries.shape
        lengths = np.diff(vectors.offsets.to_numpy())
        out = np.zeros((len(vectors), parts * width), dtype=self.entries.dtype)
        out[np.arange(parts * width) < lengths[:, None]] = whole(vectors.flatten(), self.scale, self.exact)
        return out.reshape(len(vectors), parts, width)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.entries.ravel()).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        rows = bytes.fromhex(code)
        return [int(c) / self.scale for part, e in zip(self.entries, rows) for c in part[e]]


def whole(components: pa.Array, scale: int, exact: bool) -> np.ndarray:
    """``floor(scale * x)``, within the bound."""
    x = components.to_numpy(zero_copy_only=False).astype(np.float64)
    if exact:
        return np.floor(x * scale).astype(np.int64)
    return np.array([max(-BOUND, min(BOUND, math.floor(scale * int(c) if abs(c) >= 1 << 53 else scale * c))) for c in x.tolist()],
                    dtype=object)


def usable(vectors: pa.Array) -> np.ndarray:
    """Whether a vector is there and all its components are finite numbers."""
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    good = pa.compute.fill_null(pa.compute.is_finite(vectors.values), False).to_numpy(zero_copy_only=False)
    bad_before = np.concatenate([[0], np.cumsum(~good)])
    at = vectors.offsets.to_numpy()
    return there & (bad_before[at[1:]] == bad_before[at[:-1]])


def kept_vectors(batch: pa.RecordBatch, name: str = "vector") -> tuple[pa.RecordBatch, pa.ListArray]:
    """The rows with a usable vector, and these vectors."""
    vectors = batch.column(batch.schema.get_field_index(name))
    kept = batch.filter(pa.array(usable(vectors)))
    return kept, kept.column(batch.schema.get_field_index(name))


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(quoted(key).cast("long").alias("vec_id"), quoted(vector).alias("vector"))


def first_vectors(rows: DataFrame, key: str, vector: str, entries: int, scale: int) -> tuple[list[list[int]], int, int]:
    """The whole-number vectors of the ``entries`` smallest ids; the longest length and the largest number of all.

    Each task keeps its own few smallest ids, and only those are ordered. Of the rows of a repeated id the
    smallest vector counts; a null id comes after all others.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few: dict[int | None, list[int]] = {}
        longest, largest = 0, 0
        for batch in batches:
            kept, vectors = kept_vectors(batch)
            if not kept.num_rows:
                continue
            ends = vectors.offsets.to_numpy()
            longest = max(longest, int(np.diff(ends).max()))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat):
                largest = max(largest, min(BOUND, math.ceil(float(np.abs(flat).max())) * scale + scale))
            ids = kept.column(0).to_pylist()
            order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0))
            taken: set = set()
            for r in order:
                taken.add(ids[r])
                if len(taken) > entries:
                    break
                numbers = whole(vectors.slice(r, 1).flatten(), scale, False).tolist()
                few[ids[r]] = min(few.get(ids[r], numbers), numbers)
            few = dict(sorted(few.items(), key=lambda kv: (kv[0] is None, kv[0] or 0))[:entries])
        if few:
            n = len(few)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(few), pa.int64()), pa.array([[Decimal(c) for c in v] for v in few.values()], pa.list_(_NUMBER)),
                pa.array([longest] * n, pa.int64()), pa.array([Decimal(largest)] * n, _NUMBER)],
                ["vec_id", "numbers", "longest", "largest"])

    found = written(_vectors(rows, key, vector).mapInArrow(
        giving_back(run), "vec_id long, numbers array<decimal(38,0)>, longest long, largest decimal(38,0)"), "codes-first")
    most = found.agg(F.max("longest").alias("longest"), F.max("largest").alias("largest")).first()
    first = found.groupBy("vec_id").agg(F.min("numbers").alias("numbers")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    return [[int(c) for c in r["numbers"]] for r in first.collect()], int(most["longest"] or 0), int(most["largest"] or 0)


def learn(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all vectors of ``rows``, or None if there is no vector.

    Every component x becomes ``floor(scale * x)``, and vectors are cut into ``parts`` equal parts. A
    codebook starts as that part of the vectors with the smallest ids; each round assigns every part to its
    nearest entry and moves each entry to the floor of its parts' mean. Each round is one pass over the table:
    tasks return sums per entry, which Spark adds up; the driver holds ``entries`` times one vector.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry is written as two hex digits")
    first, longest, largest = first_vectors(rows, key, vector, entries, scale)
    if not first:
        return None
    width = -(-longest // parts)
    start = np.zeros((len(first), parts * width), dtype=object)
    for row, numbers in zip(start, first):
        row[:len(numbers)] = numbers
    books = Codebooks(start.reshape(len(first), parts, width).transpose(1, 0, 2), scale,
                      exact=(2 * largest) ** 2 * max(longest, 1) <= LARGEST)
    narrow = _vectors(rows, key, vector).select("vector")
    for _ in range(rounds):
        books = _moved(narrow, books)
    return books


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        sums = np.zeros((parts, entries, width), dtype=object)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = books.parts_of(kept_vectors(batch)[1])
            for p in range(parts):
                code, _, _ = nearest(trees[p], books.entries[p], x[:, p])
                counts[p] += np.bincount(code, minlength=entries)
                for e in np.unique(code):
                    sums[p, e] += x[code == e, p].sum(axis=0)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(p, width + 1), pa.int32()), pa.array(np.repeat(e, width + 1), pa.int32()),
                pa.array(np.tile(np.arange(-1, width), len(p)), pa.int32()),
                pa.array([Decimal(int(c)) for i, j in zip(p, e) for c in (counts[i, j], *sums[i, j])], _NUMBER)],
                ["part", "entry", "at", "total"])

    sums = vectors.mapInArrow(giving_back(run), "part int, entry int, at int, total decimal(38,0)")
    totals = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in
              sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()}  # one codebook's size
    moved = books.entries.astype(object)
    for (p, e, at), total in totals.items():
        if at >= 0:
            moved[p, e, at] = total // totals[p, e, -1]
    return Codebooks(moved, books.scale, books.exact)


def encode(rows: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """``(row, code, error)`` for each row of ``rows`` with a usable vector; ``row`` holds all its columns.

    ``code`` names the nearest entry of every part, two hex digits each; ``error`` is the sum of the squared
    distances in whole numbers, the largest long where it is beyond. Rows whose vector is null or holds
    null or non-finite components are left out; an empty vector counts as zeros, as do the ends of vectors
    that are shorter than the longest. Components beyond 10^27 over the scale count as that bound.
    Repeated rows and ids have a result each; no codebooks (an empty table) give no rows. No shuffle.
    """
    narrow = rows.select(whole_row(rows).alias("row"), quoted(vector).alias("vector"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees() if books else []
        for batch in batches:
            kept, vectors = kept_vectors(batch)
            if books is None or not kept.num_rows:
                continue
            for at in range(0, kept.num_rows, BLOCK):
                x = books.parts_of(vectors.slice(at, BLOCK))
                found = [nearest(tree, book, x[:, p])[:2] for p, (tree, book) in enumerate(zip(trees, books.entries))]
                codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                error = sum(apart for _, apart in found)
                yield pa.RecordBatch.from_arrays([
                    kept.column(0).slice(at, BLOCK), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    pa.array([min(int(e), LARGEST) for e in error], pa.int64())], ["row", "code", "error"])

    return narrow.mapInArrow(giving_back(run), f"row {narrow.schema['row'].dataType.simpleString()}, code string, error long")


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows with the same label, nulls together; the largest long
    where it is beyond. A label may hold any share of the rows: its errors are added up before the
    shuffle, and the few sums come back by a join."""
    rows = coded.select(whole_row(coded).alias("row"))
    of, error = F.col("row").getField(label), F.col("row").getField("error")
    sums = rows.groupBy(of.alias("label")).agg(F.sum(error.cast("decimal(38,0)")).alias("total"))
    total = F.least("total", F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")
    return rows.join(sums, of.eqNullSafe(F.col("label"))).select(
        *[F.col("row").getField(c).alias(c) for c in coded.columns], total)
