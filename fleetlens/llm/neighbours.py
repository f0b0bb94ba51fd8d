"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.vectors import cosines, matrix, units, vectors_of

#: Trees, and bits of a hash string.
TREES, BITS = 64, 32
#: Rows of the index that one forest holds, queries that visit it together, and candidates that
#: a query gathers from it before they are ranked.
SHARD_ROWS, QUERY_ROWS, CANDIDATES = 8192, 2048, 3000
SEED = 71


class Forest:
    """Sorted arrays of hash strings, one per tree, over the unit rows of one shard."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.rows, self.trees, self.bits = rows, trees, bits
        self.planes = np.random.Generator(np.random.PCG64(SEED)).standard_normal((trees * bits, rows.shape[1]))
        codes = self.strings(rows)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """Hash strings of ``rows`` per tree, as whole numbers of ``bits`` bits."""
        signs = (rows @ self.planes.T > 0).reshape(len(rows), self.trees, self.bits)
        weight = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)
        return np.ascontiguousarray((signs @ weight).T)

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """Descend: per tree and query, the longest prefix that any row shares, by the two sorted neighbours."""
        out = np.empty(codes.shape, dtype=np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], codes[t])
            near = [codes[t] ^ self.sorted[t][np.clip(at + d, 0, self.sorted.shape[1] - 1)] for d in (-1, 0)]
            apart = np.minimum(*near)
            out[t] = self.bits - np.ceil(np.log2(apart + 1)).astype(np.int64)
        return out

    def ranges(self, codes: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the stretch of the sorted array that shares ``prefix`` bits."""
        low = codes >> (self.bits - prefix) << (self.bits - prefix)
        high = low + (1 << (self.bits - prefix))
        begin, end = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(self.trees):
            begin[t] = np.searchsorted(self.sorted[t], low[t])
            end[t] = np.searchsorted(self.sorted[t], high[t])
        return begin, end

    def candidates(self, queries: np.ndarray, least: int):
        """Per query, the rows that share its longest prefixes: all trees ascend together, one bit at a
        time, until at least ``least`` rows are gathered or all are."""
        codes = self.strings(queries)
        least = min(least, len(self.rows))
        level = self.longest(codes).max(axis=0)
        open_ = np.arange(len(queries))
        for prefix in range(self.bits, -1, -1):
            turn = open_[level[open_] >= prefix]
            if not len(turn):
                continue
            begin, end = self.ranges(codes[:, turn], prefix)
            # Fewer entries than rows wanted: nothing to count yet, the next bit is dropped.
            enough = (end - begin).sum(axis=0) >= least
            found = []
            for k in np.flatnonzero(enough).tolist():
                mark = np.zeros(len(self.rows), dtype=bool)
                for t in range(self.trees):
                    mark[self.order[t, begin[t, k]:end[t, k]]] = True
                rows = np.flatnonzero(mark)
                if len(rows) >= least:
                    found.append(turn[k])
                    yield int(turn[k]), rows
            open_ = np.setdiff1d(open_, np.array(found, dtype=np.int64), assume_unique=True)
            if not len(open_):
                return


def _search(group: pa.Table, k: int, least: int) -> pa.Table:
    """The ``k`` nearest found of one shard for one block of queries."""
    asks = group["asks"].to_numpy()
    ids = group["vec_id"].to_numpy()
    x, _ = units(matrix(group["vector"]))
    at = np.flatnonzero(~asks)
    # By id: ties then fall to the smaller id.
    at = at[np.argsort(ids[at], kind="stable")]
    several = len(np.unique(ids[at])) < len(at)
    row_ids, rows = ids[at], x[at]
    query_ids, queries = ids[asks], x[asks]
    out_query, out_id, out_score = [], [], []
    if len(rows) and len(queries):
        for q, near in Forest(rows).candidates(queries, least + 1):
            near = near[row_ids[near] != query_ids[q]]
            rough = rows[near] @ queries[q]
            if len(near) > k and not several:
                cut = np.partition(rough, len(rough) - k)[len(rough) - k]
                near = near[rough >= cut - 1e-9]
            score = cosines(rows[near], queries[q][None, :])
            best = np.lexsort((row_ids[near], -score))
            if several:  # an id counts once, by its nearest vector
                best = best[np.sort(np.unique(row_ids[near][best], return_index=True)[1])]
            best = best[:k]
            out_query.append(np.full(len(best), query_ids[q]))
            out_id.append(row_ids[near][best])
            out_score.append(score[best])

    def whole(parts: list, kind) -> pa.Array:
        return pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind))

    return pa.table({"query_id": whole(out_query, np.int64), "vec_id": whole(out_id, np.int64),
                     "score": whole(out_score, np.float64)})


def nearest(rows: DataFrame, is_query: Column, k: int = 5, candidates: int = CANDIDATES,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` nearest rows by cosine for every row of ``rows (vec_id, embedding)`` with ``is_query``.

    ``(query_id, rank, vec_id, score)``, nearest first, ties to the smaller id. Rows are cut into shards
    of bounded size by the hash of id and vector; each holds a forest of its rows, is visited by blocks of
    queries, and returns its ``k`` best, of which the best overall are taken. A hot or repeated vector
    is spread over the shards, and tasks hold one shard and one block whatever the table's size.

    A query's own id is never its neighbour. Vectors that are null, empty, zero or not finite, and
    rows without an id, take no part; vectors are compared with those of their length. Rows that
    repeat id and vector are one row, and are so before they are shuffled. An id with different vectors
    is found once, by the nearest of them; as a query it is its smallest vector. Fewer than ``k`` others: all of
    them. An empty table gives no rows.
    """
    own = vectors_of(rows).where(F.col("usable") & F.col("vec_id").isNotNull()).select("vec_id", "vector", F.size("vector").alias("dim"))
    chosen = rows.where(is_query)
    asks = vectors_of(chosen).where(F.col("usable") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(
        F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(chosen.count() / query_rows))
    stored = own.distinct().select("dim", "vec_id", "vector", F.lit(False).alias("asks"),
                        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    visiting = asks.select("dim", "vec_id", "vector", F.lit(True).alias("asks"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        return _search(group, k, candidates)

    found = stored.unionByName(visiting).groupBy("dim", "shard", "block").applyInArrow(
        search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
