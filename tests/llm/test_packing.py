import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def reference(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


STRANGE = [
    "", " ", "Hello, world's 'll I'VE can't 123 4.5", "naïve CAFÉ ŒUVRE Ŝ ſ ÿ Ÿ İstanbul ΣΑΣ ς", "日本語 テスト \U0001f600\U0001f468‍\U0001f469",
    "<|startoftext|> a<|endoftext|>b <|", "é å Ω Å ﬁ Ǆ ẞ", "x y z w\x85v\x1cu\x0bt", "a\x00b \x01 \x7f", "a_b-c...d!!??  ''s 's't",
    "ABC" * 300, "é" * 500, "İİ", "mixed日本a1é's", "ẞꙊ", "﻿bom ​zero",
]


def test_ids_are_the_tokenizers(tokenizer):
    flat, at = packing.Words(packing.vocabulary_path()).ids(pa.array(STRANGE))
    for i, text in enumerate(STRANGE):
        assert flat[at[i]:at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_character_below_u3000(tokenizer):
    """Alone, between letters, and after a capital: normalisation must not differ."""
    words = [w for c in range(1, 0x3000) for w in (chr(c), f"a{chr(c)}b", f"É{chr(c)}")]
    flat, at = packing.Words(packing.vocabulary_path()).ids(pa.array(words))
    want = [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert [flat[at[i]:at[i + 1]].tolist() for i in range(len(words))] == want


def test_plain_words_are_cut_together(tokenizer):
    """Only words with a strange character are cut alone, and slices of a longer array give the same ids."""
    texts = pa.array(["skipped", "The river, the RIVER: 12½ naïve_été...x", "", " don't <|x 日本 ", "River's end.\n(river)"]).slice(1)
    words = packing.Words(packing.vocabulary_path())
    flat, at = words.ids(texts)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert [flat[at[i]:at[i + 1]].tolist() for i in range(4)] == want
    assert set(words.words) - {""} == {"don't", "<|x", "日本", "River's"}


def test_blocks_join_and_cut_batches(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(["x" * n for n in sizes])], ["doc_id", "text"])
               for ids, sizes in [([1, 2], [4, 0]), ([3], [3]), ([4, 5, 6], [3, 25, 2]), ([7], [0])]]
    assert [b.column(0).to_pylist() for b in packing._blocks(batches)] == [[1, 2, 3, 4], [5], [6, 7]]
    empty = pa.RecordBatch.from_arrays([pa.array([8, 9]), pa.array(["", ""])], ["doc_id", "text"])
    assert [b.column(0).to_pylist() for b in packing._blocks([empty, empty])] == [[8, 9, 8, 9]]
    assert list(packing._blocks([])) == []


def check(rows, docs, tokenizer, sequence=2048):
    """Pieces put together again are the documents; sequences are full, gapless and hardly padded."""
    by, left = defaultdict(list), Counter()
    for r in rows:
        by[r["doc_id"]].append(r)
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(reference(tokenizer, text).tobytes())
    assert set(by) == set(texts)
    for doc_id, want in texts.items():
        if len(want) == 1:
            pieces = sorted(by[doc_id], key=lambda r: r["start"])
            assert b"".join(bytes(p["ids"]) for p in pieces) == want[0]
            assert all(p["doc_tokens"] == len(want[0]) // 4 and len(p["ids"]) == 4 * p["length"] for p in pieces)
            assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
        else:
            left[doc_id] = sum(p["length"] for p in by[doc_id]) - sum(map(len, want)) // 4
    assert not any(left.values())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= sequence and all(n > 0 for _, n in parts)
    return sum(n for p in sequences.values() for _, n in p) / (sequence * len(sequences))


def test_documents_come_back_whole(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    assert check(rows, [(d["doc_id"], d["text"]) for d in docs.collect()], tokenizer) > 0.99


@pytest.mark.parametrize("sequence, shard", [(64, 5), (2048, 3), (7, 1024)])
def test_small_sequences_and_shards(docs, tokenizer, sequence, shard, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    rows = packing.pack(docs, sequence=sequence).collect()
    check(rows, [(d["doc_id"], d["text"]) for d in docs.collect()], tokenizer, sequence)


def test_index_against_plain_bm25():
    rng = np.random.default_rng(1)
    tails = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(90)]
    idf, mean = rng.random(100).astype(np.float64) + 0.1, 20.0
    index = packing.Shard(tails, idf, mean)
    for seed in range(0, 90, 7):
        terms = set(tails[seed].tolist())
        def score(d):
            norm = packing.K1 * (1 - packing.B + packing.B * len(tails[d]) / mean)
            return sum(idf[t] * (tf := int((tails[d] == t).sum())) * (packing.K1 + 1) / (tf + norm) for t in terms)
        index.used[:] = False
        index.used[[seed, 3]] = True
        order = []
        for piece in index.neighbours(seed):
            index.used[piece] = True
            order.append(piece)
        assert sorted(order) == [d for d in range(90) if d not in (seed, 3)]
        want = [score(d) for d in order]
        assert all(a >= b - 1e-6 for a, b in zip(want, want[1:]))


def test_frequent_terms_as_a_matrix(monkeypatch):
    """However many of the terms are in it, the best neighbours and their order stay."""
    rng = np.random.default_rng(3)
    tails = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(90)]
    idf = rng.random(100) + 0.1
    found = []
    for cells in (0, 90 * 20, 4_000_000):
        monkeypatch.setattr(packing, "CELLS", cells)
        index = packing.Shard(tails, idf, 20.0)
        assert index.dense.size == min(cells, 90 * 60)
        found.append([list(index.neighbours(seed)) for seed in range(0, 90, 4)])
    assert found[0] == found[1] == found[2]


def test_neighbours_share_a_window(spark):
    """Documents on two subjects, mixed in the table, are packed by subject."""
    rng = np.random.default_rng(2)
    subjects = [["river", "water", "boat", "fish", "harbour", "island", "tide"], ["engine", "wheel", "motor", "brake", "piston", "clutch", "gear"]]
    rows = [(i, " ".join(rng.choice(subjects[i % 2], 30)), "en", "s", 0) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    found = defaultdict(list)
    for r in packing.pack(table, sequence=256).collect():
        found[r["sequence_id"]].append(r["doc_id"] % 2)
    pure = [max(np.mean(s), 1 - np.mean(s)) for s in found.values()]
    assert np.mean(pure) > 0.9


def test_long_documents_are_matched_by_their_whole_text(spark, tokenizer):
    """Tails that agree in all documents: only what stands before them tells the subjects apart."""
    rng = np.random.default_rng(5)
    subjects = [["river", "water", "boat", "fish", "harbour", "island", "tide"], ["engine", "wheel", "motor", "brake", "piston", "clutch", "gear"]]
    rows = []
    for i in rng.permutation(200).tolist():
        body = " ".join(rng.choice(subjects[i % 2], 50))
        fill = -len(tokenizer.encode(body, add_special_tokens=False).ids) % 64 + 9
        rows.append((i, f"{body}{' the' * fill}", "en", "s", 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    found = defaultdict(list)
    for r in packing.pack(table, sequence=64).collect():
        if r["start"] >= r["doc_tokens"] // 64 * 64:
            assert r["doc_tokens"] % 64 == 10
            found[r["sequence_id"]].append(r["doc_id"] % 2)
    pure = [max(np.mean(s), 1 - np.mean(s)) for s in found.values()]
    assert len(found) > 20 and np.mean(pure) > 0.9


def test_subjects_meet_across_partitions(spark, monkeypatch):
    """Thirty subjects that share common words, in random order over many partitions and in small shards."""
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30 * 8)]
    rows = []
    for i in rng.permutation(1500).tolist():
        own = rng.choice(words[i % 30 * 8:i % 30 * 8 + 8], 12)
        rows.append((i, " ".join([*own, *rng.choice(["the", "of", "and", "in", "to", "a", "is"], 12)]), "en", "s", 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(30)
    found = defaultdict(list)
    for r in packing.pack(table, sequence=256).collect():
        found[r["sequence_id"]].append(r["doc_id"] % 30)
    pure = [max(map(s.count, s)) / len(s) for s in found.values()]
    assert np.mean(pure) > 0.6


def test_odd_tables(odd_docs, odd_rows, no_docs, clashing_docs, tokenizer):
    for table in (odd_docs, clashing_docs):
        rows = packing.pack(table).collect()
        check(rows, [(r[0], r[1]) for r in odd_rows], tokenizer)
        assert [(r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows if r["doc_id"] == 1] == [(1, zlib.crc32(b"\1\0\0\0"))]
    assert packing.pack(no_docs).collect() == []
