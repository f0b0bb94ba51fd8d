"""Ranked lexical search turned round: the items are indexed, and the documents stream through the index.

The items' terms make a small inverted index that every task gets. Documents are cut into terms once; what is
kept of each is its length and how often it holds the items' terms. Each task then streams these counts through
the index into one bounded list of best documents per item, and the lists are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import giving_back, quoted
from fleetlens.session import written

K = 20
#: Bytes of terms and postings of the items that are searched at a time, about; the index a task holds.
BLOCK_BYTES = 16 << 20
#: Bytes of a text that are cut into terms at a time, about, and documents times items scored at a time.
SLICE, CELLS = 1 << 20, 1 << 21
#: Lists of an item that are merged apart before its last merge.
SALTS = 16

# Fixed values of the score.
K1, B, ONE = 12, 25, 1_000_000_000

#: Terms hold digits, letters and all beyond ASCII; of letters only A to Z become small.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> Counter:
    """How often a text in UTF-8 holds each term. A long text is cut slice by slice, between terms."""
    counts: Counter = Counter()
    if text:
        at = 0
        while at < len(text):
            end = at + SLICE
            parts = [text[at:end].translate(_FOLD)]
            while end < len(text) and parts[-1][-1] != 32:  # the last term goes on, maybe for long
                more = text[end:end + SLICE // 16].translate(_FOLD)
                parts.append(more[:more.find(32) + 1] or more)
                end += len(parts[-1])
            counts.update(b"".join(parts).split())
            at = end
    return counts


class Index(NamedTuple):
    """Terms of a block of items: numbered, and for each the items that hold it, how often."""

    numbers: dict[bytes, int]
    ids: list[int | None]
    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, term, times)``. Of rows that repeat an id the smallest text counts; a null id is an id."""
    one = items.select(quoted(key).cast("long").alias("item_id"), quoted(text).cast("string").alias("text")).groupBy("item_id").agg(
        F.min("text").cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = terms(raw)
                if counts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()),
                        pa.array(list(counts.values()), pa.int64())], ["item_id", "term", "times"])

    return one.mapInArrow(giving_back(run), "item_id long, term binary, times long")


def index_of(rows: list[tuple[int | None, bytes, int]]) -> Index:
    numbers = {t: i for i, t in enumerate(sorted({bytes(r[1]) for r in rows}))}
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, i or 0))
    at = {item: i for i, item in enumerate(ids)}
    post = np.array(sorted((numbers[bytes(term)], at[item], times) for item, term, times in rows), dtype=np.int64).reshape(-1, 3)
    starts = np.searchsorted(post[:, 0], np.arange(len(numbers) + 1))
    return Index(numbers, ids, starts, post[:, 1], post[:, 2])


def counted(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, term, tf)`` of documents that hold a term at all: all their terms with repeats, and the
    numbers and counts of those that the index knows."""
    narrow = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).cast("string").cast("binary").alias("text"))
    numbers = index.numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, term, tf = [], [], [], []
            for r, raw in enumerate(batch.column(1)):
                counts = terms(raw.as_py())
                if counts:
                    known = sorted((numbers[t], counts[t]) for t in counts.keys() & numbers.keys())
                    kept.append(r)
                    n.append(counts.total())
                    term.append([t for t, _ in known])
                    tf.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())),
                pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return narrow.mapInArrow(giving_back(run), "doc_id long, n long, term array<int>, tf array<long>")


def weights(documents: int, held_by: np.ndarray) -> np.ndarray:
    """The weight of terms that so many of the documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held_by], dtype=np.int64)


def lengths(n: list[int], documents: int, words: int) -> np.ndarray:
    """How long documents are beside the mean; as Python's numbers, since the product may pass 64 bits."""
    return np.array([100 - B + B * x * documents // words for x in n], dtype=np.int64)


class Best:
    """The best ``k`` documents of every item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.items = k, items
        self.item, self.score, self.doc = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.null = np.empty(0, dtype=bool)  # documents without an id come after those of the same score
        self.floor = np.ones(items, dtype=np.int64)  # what a document must reach

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``score`` is (documents, items)."""
        row, item = np.nonzero(score >= self.floor)
        item, found, doc, null = (np.concatenate(pair) for pair in (
            (self.item, item), (self.score, score[row, item]), (self.doc, doc[row]), (self.null, null[row])))
        order = np.lexsort((doc, null, -found, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.k]
        self.item, self.score, self.doc, self.null = item[order], found[order], doc[order], null[order]
        counts = np.bincount(self.item, minlength=self.items)
        ends = np.cumsum(counts) - 1
        full = counts == self.k
        self.floor[full] = self.score[ends[full]]


def scored(counts: DataFrame, index: Index, weight: np.ndarray, documents: int, words: int, k: int = K) -> DataFrame:
    """``(item_id, doc_id, score)``: each task's best ``k`` documents for every item."""
    ids, starts, item_of, times = index.ids, index.starts, index.item, index.times

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                doc, held = part.column(0), part.column(2)
                m = lengths(part.column(1).to_pylist(), documents, words)
                term = held.flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy()
                row = np.repeat(np.arange(len(doc)), np.diff(held.offsets.to_numpy()))
                gain = weight[term] * (ONE * tf // (1000 * tf + K1 * m[row]))
                score = np.zeros(len(doc) * len(ids), dtype=np.int64)
                size = starts[term + 1] - starts[term]
                ends = np.cumsum(size)
                begin = 0
                while begin < len(term):  # so many postings at a time
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CELLS, side="right")))
                    s = size[begin:end]
                    post = np.arange(s.sum()) + np.repeat(starts[term[begin:end]] - np.cumsum(s) + s, s)
                    np.add.at(score, np.repeat(row[begin:end] * len(ids), s) + item_of[post], np.repeat(gain[begin:end], s) * times[post])
                    begin = end
                best.add(score.reshape(len(doc), -1), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in best.item], pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null),
            pa.array(best.score, pa.int64())], ["item_id", "doc_id", "score"])

    return counts.mapInArrow(giving_back(run), "item_id long, doc_id long, score long")


def merged(lists: DataFrame, k: int = K) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the best ``k`` of all lists; first by parts of an item's rows, so that
    an item's last merge takes as many rows whatever the number of tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = lists.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order)))
    last = some.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return last.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents that score highest for each item, best first.

    Terms are runs of digits, letters and characters beyond ASCII; a document's score sums, over the item's
    terms with repeats, the term's weight times a fraction that saturates with its count and shrinks
    with the document's length, all in whole numbers. Equal scores go by ascending id, null ids last.
    Only scores above 0 count, so an item may have fewer documents or none. Null and empty texts have no term;
    long texts are cut in slices; repeated documents are documents of their own; of items that repeat an id the
    smallest text counts; other columns are not read; an empty table on either side gives no rows.

    Items are dealt into blocks of about ``block_bytes``, by the measured size of their terms, and the
    documents are read once for each block; a task holds one block's index and lists. Document
    counts are those of all documents.
    """
    spark = docs.sparkSession
    wanted = written(item_terms(items), "search-items")
    size = wanted.agg(F.sum(F.length("term") + 24).alias("size")).first()["size"] or 0
    blocks = -(-size // block_bytes)
    block = F.pmod(F.xxhash64(F.lit("block"), "item_id"), F.lit(max(blocks, 1)))
    lists = [_searched(docs, index_of([tuple(r) for r in wanted.where(block == b).collect()]), k) for b in range(blocks)]
    found = [x for x in lists if x is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return merged(out, k)


def _searched(docs: DataFrame, index: Index, k: int) -> DataFrame | None:
    """The tasks' lists for one block of items."""
    if not index.ids:
        return None
    counts = written(counted(docs, index), "search-counts")
    totals = counts.agg(F.count("*").alias("documents"), F.sum(F.col("n").cast("decimal(38,0)")).alias("words")).first()
    if not totals["documents"]:
        return None
    size = len(index.numbers)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(held[term], pa.int64())], ["term", "df"])

    held = np.zeros(size, dtype=np.int64)
    tallies = counts.select("term").mapInArrow(giving_back(tally), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in tallies.collect():  # one row per term of the block
        held[r["term"]] = r["df"]
    documents = int(totals["documents"])
    return scored(counts, index, weights(documents, held), documents, int(totals["words"]), k)
