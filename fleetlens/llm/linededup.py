"""Removal of repeated passages by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import giving_back, quoted, row_key

#: Lines that the rolling hash covers, and one in how many positions is a boundary.
WINDOW, MEAN_LINES = 2, 3
#: A line of so many words is a passage in itself: boundaries stand before and after it.
PASSAGE_WORDS = 50


def boundaries(lines: list[bytes], window: int = WINDOW, mean: int = MEAN_LINES,
               passage: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, long)``: where the chunks of ``lines`` start, and which lines are passages.

    A polynomial rolling hash over the hashes of the last ``window`` lines decides whether a chunk
    ends after a line, so boundaries depend on near lines alone: lines put in or taken out elsewhere
    do not shift them. A line of ``passage`` or more words is a chunk of its own.
    """
    n = len(lines)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(line) for line in lines), np.uint64, n)
    rolled = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for back in range(window - 1, -1, -1):
        rolled *= factor
        rolled[back:] += hashes[:n - back]
    mixed = rolled ^ (rolled >> np.uint64(31))
    ends = (mixed * factor >> np.uint64(33)) % np.uint64(mean) == 0
    long = np.fromiter((len(line) >= 2 * passage - 1 and len(line.split()) >= passage for line in lines), bool, n)
    begins = np.zeros(n, dtype=bool)
    begins[0] = True
    begins[1:] |= ends[:-1] | long[1:] | long[:-1]
    return np.flatnonzero(begins), long


def chunks(text: bytes) -> Iterator[tuple[int, bytes]]:
    """``(first line, bytes)`` of the chunks that can be removed: several lines, or one long passage."""
    lines = text.split(b"\n")
    if len(lines) == 1 and len(text) < 2 * PASSAGE_WORDS - 1:
        return
    starts, long = boundaries(lines)
    ends = np.append(starts[1:], len(lines))
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a > 1 or long[a]:
            chunk = b"\n".join(lines[a:b])
            if not chunk.isspace() and chunk:
                yield a, chunk


def without(text: bytes, first_lines: list[int]) -> bytes:
    """A text without the chunks that start at these lines."""
    lines = text.split(b"\n")
    starts, _ = boundaries(lines)
    ends = np.append(starts[1:], len(lines))
    gone = set(first_lines)
    kept = [b"\n".join(lines[a:b]) for a, b in zip(starts.tolist(), ends.tolist()) if a not in gone]
    return b"\n".join(kept)


def _cleaned(text: bytes | None, first_lines: list[int] | None) -> str | None:
    if text is None:
        return None
    return (without(text, first_lines) if first_lines else text).decode()


def _digest(chunk: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(chunk)
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def occurrences(docs: DataFrame, with_bytes: bool) -> DataFrame:
    """``(h, g, doc_id, a, b, line[, chunk])``: every removable chunk's 128-bit hash and place."""
    narrow = docs.select(quoted("doc_id").alias("doc_id"), row_key(docs).alias("key"),
                         quoted("text").cast("string").cast("binary").alias("text")).select("doc_id", "key.a", "key.b", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, chunk, held = [], [], [], 0
            for i, text in enumerate(batch.column(3)):
                raw = text.as_py()
                for line, content in (chunks(raw) if raw else ()):
                    at.append(i)
                    place.append((*_digest(content), line))
                    if with_bytes:
                        chunk.append(content)
                        held += len(content)
                if held > 16_000_000:
                    yield rows(batch, at, place, chunk)
                    at, place, chunk, held = [], [], [], 0
            if at:
                yield rows(batch, at, place, chunk)

    def rows(batch: pa.RecordBatch, at: list[int], place: list[tuple], chunk: list[bytes]) -> pa.RecordBatch:
        h, g, line = (pa.array(np.array(v, dtype=np.int64)) for v in zip(*place))
        keys = [batch.column(k).take(pa.array(at)) for k in range(3)]
        return pa.RecordBatch.from_arrays([h, g, *keys, line, *([pa.array(chunk, pa.binary())] if with_bytes else [])],
                                          ["h", "g", "doc_id", "a", "b", "line", *(["chunk"] if with_bytes else [])])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(giving_back(run), f"h long, g long, doc_id {kind}, a long, b long, line long"
                             + (", chunk binary" if with_bytes else ""))


def removals(docs: DataFrame) -> DataFrame:
    """``(a, b, lines)``: per row key, the first lines of the chunks to remove.

    A chunk that occurs at several places of the table stays at the first, by id (null last), row
    key and line. Places are grouped by hash with a partial aggregation, which also takes the
    smallest and the largest of their bytes: only where these agree byte for byte is the chunk
    repeated, and a hash that different chunks share removes nothing. A chunk that a third of all
    documents share is one row per map task in that shuffle; its places then meet the short list
    of repeated hashes in a join that can be split.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "a", "b", "line")
    repeated = occurrences(docs, with_bytes=True).groupBy("h", "g").agg(
        F.count("*").alias("n"), F.min(place).alias("kept"), F.min("chunk").alias("low"), F.max("chunk").alias("high"),
    ).where("n > 1 AND low = high").select("h", "g", "kept")
    again = occurrences(docs, with_bytes=False).join(repeated, ["h", "g"]).where(place != F.col("kept"))
    return again.groupBy("a", "b").agg(F.collect_set("line").alias("lines"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks removed from their texts, each chunk kept at its first place.

    No row goes: a text may become empty. ``n_chars``, where there is such a column, follows
    the text. Null and empty texts stay as they are. Rows that agree in every column
    count as one document and are treated alike. Lines end with a line feed.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(row_key(docs).alias("key"), F.struct(*[quoted(c) for c in others]).alias("row"),
                       quoted("text").cast("string").cast("binary").alias("text")).select("key.a", "key.b", "row", "text")
    met = rows.join(removals(docs), ["a", "b"], "left").select("row", "text", "lines")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cleaned(text.as_py(), lines.as_py()) for text, lines in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    done = met.mapInArrow(giving_back(run), T.StructType([met.schema["row"], T.StructField("text", T.StringType())]))
    out = []
    for name in docs.columns:
        if name == "text":
            column = F.col("text")
        elif name == "n_chars":
            column = F.length("text").cast(docs.schema["n_chars"].dataType)
        else:
            column = F.col("row").getField(name)
        out.append(column.alias(name))
    return done.select(*out)
