"""Lexical retrieval packing: token sequences filled with documents that share their words."""

from __future__ import annotations

import re
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import giving_back, quoted, whole_text
from fleetlens.session import written

SEQUENCE = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of a shard of the index, and entries (a document's distinct terms) after which it closes.
SHARD_PIECES, SHARD_ENTRIES = 1024, 4_000_000
#: Min-hashes of a document's key, terms at most in bits, and sampled keys for each partition's bounds.
KEYS, TERM_BITS, SAMPLED = 3, 17, 64
# BM25's usual constants.
K1, B = 1.2, 0.75
#: Words and pieces whose ids a task remembers, characters that are split into words at a time, and rows and
#: words that are put together at a time.
REMEMBERED, BLOCK, OUT_ROWS, LAID = 400_000, 8_000_000, 1000, 200_000
#: Weights of a shard's frequent terms that are held as a matrix of terms and documents.
CELLS = 4_000_000

# How the tokenizer cuts a word, for characters up to U+017F: a contraction, letters, one
# numeral, or a run of other characters.
_NUMERALS = "\\d²³¹¼½¾"
_LETTER = rf"[^\W_{_NUMERALS}]"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|[{_NUMERALS}]|(?:[^\w]|_)+")

# Those characters in lower case, and their kinds for cutting whole blocks at once. Words with a
# strange one are cut one by one: contractions, special tokens and what the normaliser may change.
_LETTERS, _NUMERAL, _OTHER, _STRANGE = range(4)
_PLAIN = [chr(c) for c in range(0x180)]
_LOWER = np.array([ord(c.lower()[0]) for c in _PLAIN], dtype="<u4")
_KIND = np.array([
    _STRANGE if c in "'<İ" or not c.isprintable() else _LETTERS if re.match(_LETTER, c.lower()) else
    _NUMERAL if re.match(f"[{_NUMERALS}]", c) else _OTHER for c in _PLAIN] + [_STRANGE], dtype=np.int8)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Tokens

class Words:
    """Token ids of texts by way of their distinct words.

    White space only separates words in this tokenizer, so a text's ids are its words' ids one
    after another. A block's words are numbered, the distinct ones are cut into pieces as arrays,
    distinct pieces are looked up or go to the tokenizer's model, and the ids are put together as
    arrays. Any word that the normaliser could change other than to lower case goes through the
    whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and each one's number of them; new ones go to the model."""
        known = self.pieces
        new = [piece for piece in pieces if piece not in known]
        spelled = (p if p.isascii() else "".join(map(self.alphabet.__getitem__, p.encode())) for p in new)
        for piece, tokens in zip(new, map(self.model.tokenize, spelled)):
            known[piece] = array("I", [token.id for token in tokens]).tobytes()
        return _table([*map(known.__getitem__, pieces)])

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            # Up to U+017F every letter is composed already, and lower case is letter by letter.
            if word and max(word) < "ƀ" and "<|" not in word and "İ" not in word and word.isprintable():
                ids = self._pieces(_PIECE.findall(word.lower()))[0].tobytes()
            else:
                ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
            self.words[word] = ids
        return ids

    def _plain(self, words: pa.Array, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without strange characters, end to end, and each word's number of them."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        kind = _KIND[points]
        at = _begins(pc.utf8_length(words).to_numpy(zero_copy_only=False))
        first = np.ones(len(points), dtype=bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMERAL)
        first[at[:-1]] = True
        begins = np.flatnonzero(first)
        low = _LOWER[points]
        until = _begins(1 + (low >= 0x80))  # in bytes
        data = low.tobytes().decode("utf-32-le").encode()
        cut = pa.LargeStringArray.from_buffers(
            len(begins), pa.py_buffer(until[np.append(begins, len(points))]), pa.py_buffer(data)).dictionary_encode()
        table = self._pieces(cut.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, until = _laid_out(*table, cut.indices.to_numpy(zero_copy_only=False))
        return flat, np.diff(until[np.searchsorted(begins, at)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` end to end, and where each text's begin (one more entry than texts)."""
        if len(self.words) > REMEMBERED:
            self.words = {}
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        lists = pc.ascii_split_whitespace(texts)
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.large_string())
        points, lengths = _points(words), pc.utf8_length(words).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(words)), lengths)
        plain = lengths > 0
        plain[owner[_KIND[points] == _STRANGE]] = False
        flat, size = self._plain(words.filter(pa.array(plain)), points[plain[owner]])
        others, sizes = _table([self._word(word) for word in words.filter(pa.array(~plain)).to_pylist()])
        count = np.empty(len(words), np.int64)
        count[plain], count[~plain] = size, sizes
        first = np.empty(len(words), np.int64)
        first[plain], first[~plain] = _begins(size)[:-1], len(flat) + _begins(sizes)[:-1]
        out, until = _laid_out(np.concatenate([flat, others]), count, numbered.indices.to_numpy(zero_copy_only=False), first)
        return out, until[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def _begins(size: np.ndarray) -> np.ndarray:
    """Where entries of these sizes begin, end to end, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


def _points(words: pa.Array) -> np.ndarray:
    """Code points of all words end to end; those from U+0180 on count as that one."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:][:len(words) + 1] if len(words) else [0, 0]
    text = words.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes().decode() if at[-1] > at[0] else ""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0x180)


def _table(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _laid_out(flat: np.ndarray, size: np.ndarray, index: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a table's entries in the order of ``index``, end to end, and where each begins."""
    first = _begins(size)[:-1] if first is None else first
    until = _begins(size[index])
    out = np.empty(until[-1], "<u4")
    for a in range(0, len(index), LAID):
        at = until[a:a + LAID + 1]
        shift = np.repeat(first[index[a:a + LAID]] - at[:-1], np.diff(at))
        out[at[0]:at[-1]] = flat[shift + np.arange(at[0], at[-1])]
    return out, until


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batches in blocks of about ``BLOCK`` characters of the second column."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).tolist()):
            size += n
            if size >= BLOCK:
                yield pa.concat_batches([*held, batch.slice(start, i + 1 - start)])
                start, held, size = i + 1, [], 0
        held.append(batch.slice(start))
    if size or any(map(len, held)):
        yield pa.concat_batches(held)


_TOKENS = "tokens long, ids binary, term_docs array<struct<term: int, docs: long>>"


def tokenise(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, tokens, ids, term_docs)``: every row's token ids with the end id, as little-endian 32 bits.

    A partition's last row has ``term_docs`` instead: in how many of its documents each term occurs.
    Their number is bounded by the vocabulary. Null text counts as empty, its only id is the end id.
    """
    path = vocabulary or vocabulary_path()
    narrow = docs.select(quoted("doc_id").alias("doc_id"), whole_text().alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    term_docs = pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, type_ = Words(path), np.zeros(1 << 17, dtype=np.int64), pa.int64()
        end = np.array([end_id], dtype="<u4")
        for block in _blocks(batches):
            type_ = block.schema.field(0).type
            flat, at = words.ids(block.column(1))
            for start in range(0, len(block), OUT_ROWS):
                docs = block.column(0).slice(start, OUT_ROWS)
                rows = []
                for a, b in pairwise(at[start:start + OUT_ROWS + 1].tolist()):
                    ids = np.append(flat[a:b], end)
                    counts[bag(ids)[0]] += 1
                    rows.append(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.diff(at[start:start + OUT_ROWS + 1]) + 1), pa.array(rows, pa.binary()),
                     pa.nulls(len(rows), term_docs)], ["doc_id", "tokens", "ids", "term_docs"])
        used = np.flatnonzero(counts)
        if len(used):
            found = [{"term": t, "docs": n} for t, n in zip(used.tolist(), counts[used].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, type_), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([found], term_docs)],
                ["doc_id", "tokens", "ids", "term_docs"])

    return narrow.mapInArrow(giving_back(run), f"doc_id {kind}, {_TOKENS}")


# Retrieval

def bag(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a document, ascending, and how often each occurs."""
    terms, tf = np.unique(ids, return_counts=True)
    return terms.astype(np.int32), tf.astype(np.int32)


class Shard:
    """An inverted BM25 index over the whole documents of one shard, with the statistics of all documents.

    Documents are given by their ids or as bags of them.
    """

    def __init__(self, docs: list, idf: np.ndarray, mean: float) -> None:
        bags = [d if isinstance(d, tuple) else bag(d) for d in docs]
        owner = np.repeat(np.arange(len(bags)), [len(terms) for terms, _ in bags])
        lengths = np.array([tf.sum() for _, tf in bags], dtype=np.float64)
        flat, tf = (np.concatenate(part) for part in zip(*bags))
        by_term = np.argsort(flat, kind="stable")
        term, tf, self.piece = flat[by_term], tf[by_term], owner[by_term]
        norm = K1 * (1 - B + B * lengths / mean)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.piece])
        self.terms, self.first = np.unique(term, return_index=True)
        self.last = np.append(self.first[1:], len(term))
        self.of_piece = np.searchsorted(self.terms, flat)
        self.starts = _begins([len(terms) for terms, _ in bags])
        self.used = np.zeros(len(bags), dtype=bool)
        # Weights of the most frequent terms by piece; postings are for the others.
        count = self.last - self.first
        self.row = np.full(len(count), -1)
        frequent = np.sort(np.argsort(-count, kind="stable")[:CELLS // len(bags)])
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), len(bags)))
        row = np.repeat(self.row, count)
        self.dense[row[row >= 0], self.piece[row >= 0]] = self.weight[row >= 0]

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused pieces by BM25 against all terms of the seed, best first, ties in order."""
        terms = self.of_piece[self.starts[seed]:self.starts[seed + 1]]
        row = self.row[terms]
        score = self.dense[row[row >= 0]].sum(axis=0)
        rare = terms[row < 0]
        if len(rare):
            first, count = self.first[rare], self.last[rare] - self.first[rare]
            until = np.cumsum(count)
            at = np.repeat(first - until + count, count) + np.arange(until[-1])
            score += np.bincount(self.piece[at], self.weight[at], len(self.used))
        score[self.used] = -1
        few = min(64, len(score))  # mostly enough to fill a window
        yield from self._open(np.argpartition(-score, few - 1)[:few], score)
        yield from self._open(np.arange(len(score)), score)

    def _open(self, pieces: np.ndarray, score: np.ndarray) -> Iterator[int]:
        for piece in pieces[np.lexsort((pieces, -score[pieces]))].tolist():
            if not self.used[piece]:
                yield piece


def content_keys(bags: list[tuple], idf: np.ndarray, shared: np.ndarray, mean: float) -> list[int]:
    """Sort keys that bring documents together that share weighty terms.

    A key is a row of min-hashes, each a term: the one of the least exponential draw over its BM25 weight. Two
    documents agree in one as likely as their weights overlap. Terms of a single document are left out.
    """
    draws = np.random.Generator(np.random.PCG64(29)).standard_exponential((KEYS, len(idf))).T.copy()
    worth, norms = idf * shared, K1 * (1 - B + B * np.array([tf.sum() for _, tf in bags]) / mean)
    keys = []
    for (terms, tf), norm in zip(bags, norms.tolist()):
        weight = worth[terms] * tf / (tf + norm)
        if not weight.all():
            some = weight > 0
            terms, weight = terms[some], weight[some]
        key = 0
        if len(terms):
            for term in terms[(draws[terms].T / weight).argmin(axis=1)].tolist():
                key = key << TERM_BITS | term
        keys.append(key)
    return keys


def dealt(rows: DataFrame, n: int, idf: np.ndarray, shared: np.ndarray, mean: float) -> DataFrame:
    """``rows`` in the order of their content keys, cut into partitions of about equal numbers of rows.

    The bounds come from a sample. Rows of one key are spread over the key's stretch, so a key of many
    rows takes as many partitions as it needs.
    """
    spark = rows.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_PIECES)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def keyed(bounds: list[tuple[int, float]], whole: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spread = batch.column(3).to_pylist()
                keys = content_keys([bag(np.frombuffer(raw.as_buffer(), dtype="<u4")) for raw in batch.column(2)],
                                    idf, shared, mean)
                if whole:
                    part = [bisect_right(bounds, at) for at in zip(keys, spread)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64()), pa.array(part, pa.int32())],
                                                     [*batch.schema.names, "key", "part"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(3)], ["key", "spread"])

        return giving_back(run)

    spread = rows.select("doc_id", "tokens", "ids", F.rand(31).alias("spread"))
    bounds: list[tuple[int, float]] = []
    if parts > 1:
        drawn = spread.where(F.rand(37) < min(1.0, SAMPLED * parts / n)).mapInArrow(keyed([], False), "key long, spread double")
        sample = sorted((r["key"], r["spread"]) for r in drawn.collect())  # a bounded number for each partition
        bounds = [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []
    placed = spread.mapInArrow(keyed(bounds, True), f"doc_id {kind}, tokens long, ids binary, spread double, key long, part int")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions(
        "key", F.xxhash64("ids", "doc_id"), "spread").select("doc_id", "tokens", "ids")


def pack_pieces(tails: list[np.ndarray], index: Shard, open_: list, sequence: int) -> Iterator[list]:
    """Fill windows with the tails of a shard: lists of ``(tail, start, length)``; below 0 are open pieces carried in.

    A tail is what its document has beyond full sequences; ``index`` holds the whole documents.

    ``open_`` holds the window that the shard before left open; the last one left open here
    replaces it. The first unused piece seeds a window; its unused neighbours follow while there
    is room, and the one that does not fit is cut, its rest seeding the next window.
    """
    room = sequence - sum(length for *_, length in open_)
    window, seeds = list(open_), iter(range(len(tails)))
    seed = None

    def put(piece: int, start: int) -> Iterator[list]:
        nonlocal room, window, seed
        left = len(tails[piece]) - start
        while left:
            length = min(left, room)
            window.append((piece, start, length))
            start, left, room = start + length, left - length, room - length
            if not room:
                yield window
                window, room, seed = [], sequence, piece if left else None

    while True:
        if seed is None:
            seed = next((s for s in seeds if not index.used[s]), None)
            if seed is None:
                break
            index.used[seed] = True
            yield from put(seed, 0)
            continue
        of, closed = seed, False
        for piece in index.neighbours(of):
            index.used[piece] = True
            for full in put(piece, 0):
                closed = True
                yield full
            if closed:
                break
        if not closed:
            break
    open_[:] = window


_PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pack the token ids of ``docs`` into sequences of ``sequence`` tokens: one row per piece.

    ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, ids as little-endian 32 bits. Full
    sequences of a long document stand alone, and what is left of it is a piece to be placed. Documents
    are dealt out by content first, so that those that share weighty terms stand together wherever
    they are in the table. Shards of at most ``SHARD_PIECES`` documents in that order have an inverted
    BM25 index each, over the terms of the whole documents; document counts and mean length are
    those of all rows. In a shard each seed's window is filled with its
    best unused neighbours, the last one cut to fit and its rest the next seed. The window
    that a shard leaves open goes on in the next shard of the partition, so a partition has one
    padded sequence at most. The tokens are shuffled once, and a task holds one shard.

    Every row is a document, repeated rows and null ids too; null text is empty and still has its
    end id. An empty table gives no rows. The tokens are written to the shared folder first,
    so that ids and their order are the same for every later attempt.
    """
    tokens = written(tokenise(docs, vocabulary, end_id), "pack-tokens")
    counted = tokens.where("term_docs IS NOT NULL").select(F.explode("term_docs").alias("t")).groupBy("t.term").agg(
        F.sum("t.docs").alias("docs")).toPandas()  # one row per entry of the vocabulary
    rows = tokens.where("term_docs IS NULL").drop("term_docs")
    n, mean = rows.agg(F.count("*"), F.avg("tokens")).first()
    known = np.zeros(1 + max([1 << 16, *counted["term"]]), dtype=np.float64)
    known[counted["term"].to_numpy(np.int64)] = counted["docs"].to_numpy(np.float64)
    idf = np.log(1 + (n - known + 0.5) / (known + 0.5)).astype(np.float32)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 36
        held: list[tuple[pa.Scalar, np.ndarray, int]] = []  # doc id, tail, tokens before it
        bags: list[tuple] = []  # of their whole documents
        entries = 0
        carried: dict[int, tuple] = {}  # pieces of the window left open
        open_: list = []
        out: list[tuple] = []

        def emit(window: list, table: dict) -> None:
            nonlocal next_id
            offset = 0
            for piece, start, length in window:
                doc, ids, before = table[piece]
                out.append((doc, before + start, length, ids[start:start + length].tobytes(), before + len(ids),
                            next_id, offset))
                offset += length
            next_id += 1

        def shard() -> None:
            nonlocal carried, held, open_, bags, entries
            if not held:
                return
            table = {**carried, **dict(enumerate(held))}
            for window in pack_pieces([ids for _, ids, _ in held], Shard(bags, idf, mean), open_, sequence):
                emit(window, table)
            # The open window's pieces are renumbered below zero, apart from the next shard's.
            carried = {-1 - i: table[piece] for i, (piece, _, _) in enumerate(open_)}
            open_ = [(-1 - i, start, length) for i, (_, start, length) in enumerate(open_)]
            held, bags, entries = [], [], 0

        def flushed(type_: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 7
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            types = [type_, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        type_ = pa.int64()
        for batch in batches:
            type_ = batch.schema.field(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u4")
                full = len(ids) // sequence * sequence
                for start in range(0, full, sequence):
                    emit([(0, start, sequence)], {0: (doc, ids, 0)})
                if full < len(ids):
                    held.append((doc, ids[full:].copy(), full))
                    bags.append(bag(ids))
                    entries += len(bags[-1][0])
                if len(held) >= SHARD_PIECES or entries >= SHARD_ENTRIES:
                    shard()
                if len(out) >= 2000:
                    yield flushed(type_)
        shard()
        if open_:
            emit(open_, carried)
        if out:
            yield flushed(type_)

    return dealt(rows, n, idf, known > 1, mean).mapInArrow(giving_back(run), f"doc_id {kind}, {_PIECES}")
