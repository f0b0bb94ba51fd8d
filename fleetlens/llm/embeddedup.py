"""Near-duplicate embeddings by product quantisation: inverted lists, codebook lookups, exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.components import components
from fleetlens.llm.vectors import cosines, matrix, units, vectors_of
from fleetlens.session import written

THRESHOLD = 0.9
#: Vectors that the index is fitted on, at most about so many; vectors per list; lists at most.
SAMPLE, LIST_ROWS, MOST_LISTS = 8192, 1000, 512
#: Subspaces and codes of each.
SUBSPACES, CODES = 8, 64
#: Rows of a block, the unit that meets another, at most; blocks that small tables are cut into at least.
BLOCK, LEAST_BLOCKS = 4096, 24
#: Rows that are looked up, pairs that are verified, and rows and bytes that are searched for copies and located at a time.
ASKS, VERIFIED, COPIES, COPY_BYTES, LOCATED = 1024, 200_000, 16_384, 8_000_000, 4096


class Index:
    """Coarse centroids, and per subspace a codebook of residuals; fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        rng = np.random.Generator(np.random.PCG64(83))
        self.centroids = _means(sample, min(lists, len(sample)), rng)
        residual = sample - self.centroids[self.home(sample)[0]]
        self.cuts = [c for c in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(c)]
        self.books = [_means(residual[:, c], min(CODES, len(sample)), rng) for c in self.cuts]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest list, and squared distances to all."""
        far = (x * x).sum(1)[:, None] + (self.centroids * self.centroids).sum(1)[None] - 2 * x @ self.centroids.T
        return far.argmin(axis=1), far

    def probes(self, x: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
        """The lists that rows probe, as a mask, their own left out.

        A pair with the least cosine is a step of length sqrt(2 - 2 threshold) apart. The distances of
        two vectors in different lists from the border between these add up to the part of
        their step that points across it, so one of the two is within half the step of the border. Every
        list whose border is that near is probed: either vector may probe the other's list, so no
        pair is missed, whatever the dimension and the direction of the step.
        """
        far = self.home(x)[1]
        reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9
        gap = np.sqrt(((self.centroids[:, None] - self.centroids[None]) ** 2).sum(-1))[home]
        own = far[np.arange(len(x)), home][:, None]
        probed = far - own <= 2 * gap * reach + 1e-12  # rounding of the squares
        probed[np.arange(len(x)), home] = False
        return probed

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they miss."""
        residual = x - self.centroids[home]
        codes = np.empty((len(x), len(self.cuts)), dtype=np.uint8)
        missed = np.zeros(len(x))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            part = residual[:, cut]
            far = (part * part).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * part @ book.T
            codes[:, m] = far.argmin(axis=1)
            missed += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(missed)

    def lookup(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of exact ``queries`` with coded rows of one list.

        The rows' parts are looked up in the codebooks once, and meet all queries in one product of matrices.
        """
        rows = np.repeat(self.centroids[list_][None], len(codes), axis=0)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            rows[:, cut] += book[codes[:, m]]
        return queries.astype(np.float32) @ rows.astype(np.float32).T


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(axis=1)
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], k)
            count = np.bincount(near, minlength=k)
            centres[:, j] = np.where(count > 0, total / np.maximum(count, 1), centres[:, j])
    return centres


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``n`` rows as stars, one edge a row at most."""
    parent = np.arange(n)
    while (parent[a] != parent[b]).any():
        least = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], least)
        np.minimum.at(parent, parent[b], least)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    rows = np.flatnonzero(parent != np.arange(n))
    return rows, parent[rows]


_BLOCKS = ("block int, lists array<int>, reach array<int>, h array<long>, g array<long>, first array<long>, n array<long>, "
           "home array<int>, codes binary, missed array<double>, probed binary, vectors binary")
_MEETING = ["block", "n", "home", "codes", "missed", "probed", "vectors"]


def _merged(rows: pa.Table) -> pa.Table:
    """Rows ``(h, g, first, n, ...)`` with those of one vector made one: its smallest id and its weight."""
    keyed = rows.select(["h", "g", "first", "n"]).append_column("i", pa.array(np.arange(len(rows))))
    found = keyed.group_by(["h", "g"], use_threads=False).aggregate([("first", "min"), ("n", "sum"), ("i", "min")])
    kept = rows.drop_columns(["h", "g", "first", "n"]).take(found["i_min"])
    for name, of in (("h", "h"), ("g", "g"), ("first", "first_min"), ("n", "n_sum")):
        kept = kept.append_column(name, pc.cast(found[of], pa.int64()))
    return kept.combine_chunks()


def _located(keyed: DataFrame, index: Index) -> DataFrame:
    """``(home, h, g, first, n, vector)``: vectors with their list, copies that stand together made one."""
    def found(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _merged(pa.Table.from_batches(waiting))
        for at in range(0, len(rows), LOCATED):
            part = rows.slice(at, LOCATED)
            home = index.home(units(matrix(part["vector"]))[0])[0]
            part = part.append_column("home", pa.array(home.astype(np.int32)))
            yield from part.select(["home", "h", "g", "first", "n", "vector"]).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= COPIES or sum(b.nbytes for b in waiting) >= COPY_BYTES:
                yield from found(waiting)
                waiting = []
        if waiting:
            yield from found(waiting)

    schema = T.StructType([*T.StructType.fromDDL("home int, h long, g long, first long, n long").fields, keyed.schema["vector"]])
    rows = keyed.select("h", "g", F.col("vec_id").alias("first"), F.lit(1).cast("long").alias("n"), "vector")
    return rows.mapInArrow(run, schema)


def _dealt(index: Index, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(first, parts, n)``: the first block of every list, the blocks it is cut into, and the number of blocks.

    A list of more rows than a block is cut; lists near one another share a block.
    """
    most = min(BLOCK, max(1, math.ceil(rows / LEAST_BLOCKS)))
    parts = np.maximum(1, -(-counts // most))
    first, at, held = np.zeros(len(counts), dtype=np.int64), 0, 0
    left, here = set(range(len(counts))), 0
    while left:
        left.remove(here)
        if parts[here] > 1 or held + counts[here] > most:
            at, held = at + (held > 0), 0
        first[here] = at
        at, held = (at + parts[here], 0) if parts[here] > 1 else (at, held + counts[here])
        if left:
            some = np.array(sorted(left))
            here = int(some[((index.centroids[some] - index.centroids[here]) ** 2).sum(axis=1).argmin()])
    return first, parts, int(at + 1)


def _block(key: tuple, group: pa.Table, index: Index, threshold: float) -> pa.Table:
    """The rows of a block as one row, list by list."""
    rows = _merged(group.drop_columns("block"))
    rows = rows.sort_by([("home", "ascending"), ("h", "ascending"), ("g", "ascending")]).combine_chunks()
    home = rows["home"].to_numpy()
    raw = rows["vector"].combine_chunks()
    x = matrix(raw)
    kept = x.astype(np.float32) if pa.types.is_float32(raw.type.value_type) else x
    x = units(x)[0]
    probed = index.probes(x, home, threshold)
    codes, missed = index.encode(x, home)
    lists = np.unique(home)
    reach = np.union1d(lists, np.flatnonzero(probed.any(axis=0)))
    one = {"block": key[0].as_py(), "lists": lists, "reach": reach, "codes": codes.tobytes(), "missed": missed, "home": home,
           "probed": np.packbits(probed, axis=1).tobytes(), "vectors": kept.tobytes(),
           **{name: rows[name].combine_chunks() for name in ("h", "g", "first", "n")}}
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
             "array<double>": pa.list_(pa.float64())}

    def column(value: object, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array([value], kind)
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value).cast(kind.value_type))

    return pa.table({name: column(one[name], kinds[kind]) for name, kind in (f.split(" ") for f in _BLOCKS.split(", "))})


class Block:
    """A block as it meets others."""

    def __init__(self, row: dict, index: Index) -> None:
        self.number, self.n = row["block"].as_py(), row["n"].values.to_numpy()
        self.home, self.missed = row["home"].values.to_numpy(), row["missed"].values.to_numpy()
        self.codes = np.frombuffer(row["codes"].as_py(), np.uint8).reshape(len(self), -1)
        bits = np.frombuffer(row["probed"].as_py(), np.uint8).reshape(len(self), -1)
        self.probed = np.unpackbits(bits, axis=1, count=len(index.centroids)).astype(bool)
        raw, width = row["vectors"].as_py(), index.centroids.shape[1]
        vectors = np.frombuffer(raw, np.float32 if len(raw) == 4 * width * len(self) else np.float64)
        self.x = units(vectors.astype(np.float64).reshape(len(self), width))[0]
        self.lists = {int(c): np.flatnonzero(self.home == c) for c in np.unique(self.home)}
        self.node = (self.number << 32) + np.arange(len(self), dtype=np.int64)

    def __len__(self) -> int:
        return len(self.n)


def _visits(of: Block, to: Block, own: bool, index: Index, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that are near, of rows and of the rows of the lists they probe in another block.

    With ``own``, rows of a list of both meet as well; without it, pairs are left out whose second row probes the
    list of the first, for they have met the other way.
    """
    for list_, rows in to.lists.items():
        if own:
            meeting = [(np.flatnonzero(of.probed[:, list_] | (of.home == list_)), rows)]
        else:
            meeting = [(some[of.probed[some, list_]], rows[~to.probed[rows, home]]) for home, some in of.lists.items()]
        for asks, asked in meeting:
            # The looked-up product is off by no more than what the codes miss.
            least = (threshold - 1e-5 - to.missed[asked]).astype(np.float32)
            for at in range(0, len(asks) if len(asked) else 0, ASKS):
                some = asks[at:at + ASKS]
                close = index.lookup(of.x[some], list_, to.codes[asked]) >= least
                q, r = np.divmod(np.flatnonzero(close), len(asked))
                q, r = some[q], asked[r]
                if of is to:
                    # Each pair once: of one list in order; one that meets in both its lists in the first of them.
                    home = of.home[q]
                    once = np.where(home == list_, q < r, ~of.probed[r, home] | (list_ < home))
                    q, r = q[once], r[once]
                for part in range(0, len(q), VERIFIED):
                    a, b = q[part:part + VERIFIED], r[part:part + VERIFIED]
                    near = cosines(of.x[a], to.x[b]) >= threshold
                    yield a[near], b[near]


def _compare(left: Block, right: Block, index: Index, threshold: float) -> pa.RecordBatch:
    """Links of two blocks, or within one: the weight that each row gains, and stars that connect them."""
    links = [(np.empty(0, np.int64), np.empty(0, np.int64)), *_visits(left, right, True, index, threshold)]
    if left is not right:
        links += [(b, a) for a, b in _visits(right, left, False, index, threshold)]
    a, b = (np.concatenate(p) for p in zip(*links))
    node, n = left.node, left.n
    if left is not right:
        node, n, b = np.concatenate([node, right.node]), np.concatenate([n, right.n]), b + len(left)
    gained = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
    some = np.flatnonzero(gained)
    low, high = _stars(len(node), a, b)
    return pa.RecordBatch.from_pydict({
        "a": np.concatenate([node[some], node[low]]).astype(np.int64),
        "b": np.concatenate([np.zeros(len(some), np.int64), node[high]]).astype(np.int64),
        "gained": np.concatenate([gained[some], np.zeros(len(low))]).astype(np.int64)})


def _met(blocks: DataFrame, index: Index, threshold: float) -> DataFrame:
    """``(a, b, gained)``: gained > 0 is a count for ``a``, 0 an edge.

    Tasks read the blocks once more for every other part of the table, so nothing is copied to disk for the pairs.
    """
    def side(name: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{name}_{c}") for c in ("lists", "reach", *_MEETING)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {side: {c: batch.column(f"{side}_{c}")[i] for c in _MEETING} for side in ("l", "r")}
                if left is None or left.number != row["l"]["block"].as_py():
                    left = Block(row["l"], index)
                same = left.number == row["r"]["block"].as_py()
                yield _compare(left, left if same else Block(row["r"], index), index, threshold)

    meet = (F.col("l_block") <= F.col("r_block")) & (
        F.arrays_overlap("l_reach", "r_lists") | F.arrays_overlap("r_reach", "l_lists"))
    pairs = side("l").join(side("r").hint("shuffle_replicate_nl"), meet)
    return pairs.drop("l_lists", "l_reach", "r_lists", "r_reach").mapInArrow(run, "a long, b long, gained long")


def _blocks(keyed: DataFrame, rows: int, threshold: float, start: int) -> tuple[DataFrame, Index, int]:
    """Vectors of one length as blocks of distinct ones, numbered from ``start``; the index, and the number that follows."""
    share = min(1.0, SAMPLE / rows)
    drawn = keyed.where(F.pmod(F.xxhash64("h", "g", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    distinct = drawn.groupBy("h", "g").agg(F.first("vector").alias("vector"))
    sample = matrix(distinct.orderBy("h", "g").select("vector").toArrow()["vector"])
    if not len(sample):
        sample = matrix(keyed.orderBy("h", "g").limit(1).select("vector").toArrow()["vector"])
    index = Index(units(sample)[0], max(1, min(MOST_LISTS, math.ceil(rows / LIST_ROWS))))
    located = _located(keyed, index)
    counts = np.zeros(len(index.centroids), dtype=np.int64)
    for row in located.select("home", "h", "g").distinct().groupBy("home").count().collect():  # one row per list
        counts[row["home"]] = row["count"]
    first, parts, blocks = _dealt(index, counts, rows)
    of = [F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("home")) for values in (first + start, parts)]
    placed = located.withColumn("block", (of[0] + F.pmod(F.xxhash64("h", F.lit("block")), of[1])).cast("int"))

    def block(key: tuple, group: pa.Table) -> pa.Table:
        return _block(key, group, index, threshold)

    return written(placed.groupBy("block").applyInArrow(block, _BLOCKS), "embed-blocks"), index, start + blocks


def clusters(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding)``.

    Rows link where the cosine is at least ``threshold``. Equal vectors are one node with a weight, so
    copies are not compared. A coarse quantiser, fitted on a bounded sample, deals the nodes out to
    inverted lists; a node visits the lists whose border is within half a link's length, which misses
    no link. Lists are kept in blocks of bounded size, and any two blocks meet of which one has visitors for the
    other: products are looked up from subspace codes, and what the codes cannot rule out is verified by the exact
    cosine in double precision, so no wrong link appears and none is lost.
    Blocks return counts and stars, never pairs. Each vector is shuffled once and written once.

    Vectors that are null, empty, zero or not finite link with nothing: 0 links, their own id, kept.
    Vectors are compared with those of their length. Repeated rows link with one another. A
    component without any id has a null id; a null id is never kept. An empty table gives no rows.
    """
    own = vectors_of(vectors)
    keyed = own.where("usable").select("vec_id", "vector", F.xxhash64("vector").alias("h"),
                                       F.xxhash64(F.lit(9), "vector").alias("g"))
    lengths = keyed.select(F.size("vector").alias("dim"), "h", "g").distinct().groupBy("dim").count()
    tables, parts, start = [], [], 0
    for d in lengths.orderBy("dim").collect():  # one row per length
        blocks, index, start = _blocks(keyed.where(F.size("vector") == d["dim"]), d["count"], threshold, start)
        tables.append(blocks.select("block", F.posexplode(F.arrays_zip("h", "g", "first", "n"))))
        parts.append(_met(blocks, index, threshold))
    if parts:
        nodes = reduce(DataFrame.unionByName, tables).select(
            (F.shiftleft(F.col("block").cast("long"), 32) + F.col("pos")).alias("node"), "col.*")
        met = written(reduce(DataFrame.unionByName, parts), "embed-links")
    else:
        nodes = vectors.sparkSession.createDataFrame([], "node long, h long, g long, first long, n long")
        met = vectors.sparkSession.createDataFrame([], "a long, b long, gained long")
    counts = met.where("gained > 0").groupBy(F.col("a").alias("node")).agg(F.sum("gained").alias("gained"))
    found = components(met.where("gained = 0")).withColumnRenamed("node", "of")
    rooted = nodes.select("node", "h", "g", "first", "n").join(counts, "node", "left").join(
        found, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Copies that rounding has put into two lists are two nodes, linked, that count the same.
    named = rooted.join(least, "root").groupBy("h", "g").agg(
        F.min("component_id").alias("component_id"), F.max(F.coalesce("gained", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = keyed.select("vec_id", "h", "g").join(named, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = own.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
