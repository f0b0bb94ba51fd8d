import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import reversed_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=20):
    held = [(i, c) for i, t in docs if (c := Counter(cut(t)))]
    n, words = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    by_id = defaultdict(list)
    for i, t in items:
        by_id[i] += [t] if t is not None else []
    out = {}
    for i, texts in by_id.items():
        asked = Counter(cut(min(texts, key=lambda t: t.encode()))) if texts else {}
        rows = []
        for doc, c in held:
            m = 75 + 25 * c.total() * n // words
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in asked.items() if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc, score))
        if rows:
            out[i] = [(doc, score) for *_, doc, score in sorted(rows)[:k]]
    return out


def found(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["item_id"]][r["rank"]] = (r["doc_id"], r["score"])
    for ranks in out.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
    return {i: [ranks[r] for r in sorted(ranks)] for i, ranks in out.items()}


ITEMS = [(1, "the same words and MORE words"), (2, None), (3, ""), (4, " .,- "), (9, "is it HERE"), (5, "ünïcode 日本語 \U0001f600 2hunter2"), (6, "nothing holds thisatall"),
         (7, "a a a row"), (7, "zz"), (None, "but another text"), (None, None), (8, "same same AGAIN x y z"), (8, "same same AGAIN x y z")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "rank", "term", "n")})


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_odd_rows(odd_rows, odd_docs, clashing_docs, items, block_bytes):
    want = brute([r[:2] for r in odd_rows], ITEMS)
    assert want and any(doc is None for rows in want.values() for doc, _ in rows)
    for docs in (odd_docs, clashing_docs):
        assert found(search.search(docs, items, block_bytes=block_bytes)) == want


def test_empty_tables(spark, no_docs, odd_docs, items):
    for docs, wanted in ((no_docs, items), (odd_docs, items.limit(0)), (odd_docs, items.where("item_id in (2, 3, 4)")),
                         (odd_docs.where("text is null"), items)):
        out = search.search(docs, wanted)
        assert out.count() == 0 and out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


@pytest.mark.parametrize("k", [1, 5, 20])
def test_ties_copies_and_common_words(spark, k):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["the"] * 60
    docs = [(i, "the " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(700)]
    docs += [(i, "the W1 w2 w2-w3") for i in range(900, 700, -1)]  # a group of copies, the smallest ids last
    items = [(i, " ".join(rng.choice(words) for _ in range(8))) for i in range(30)] + [(77, "w1 w2 w3"), (78, "the")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    out = found(search.search(df, spark.createDataFrame(items, "item_id long, text string"), k=k))
    assert out == brute(docs, items, k)


def test_documents_in_small_batches(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30))) for i in range(300)]
    items = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(5))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    at = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        assert found(search.search(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at)


def test_terms_of_long_texts(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abAB19é日 \n.-_`{") for _ in range(4000)) + "x" * 900 + " end"
    want = {t.encode(): n for t, n in Counter(cut(text)).items()}
    for size in (16, 17, 64, 1 << 20):
        monkeypatch.setattr(search, "SLICE", size)
        assert search.terms(text.encode()) == want
    assert search.terms(None) == search.terms(b"") == search.terms(b" .") == Counter()


def test_lists_stay_bounded():
    rng = np.random.default_rng(1)
    best, rows = search.Best(3, 4), []
    for _ in range(20):
        score = rng.integers(0, 6, (50, 3))
        doc, null = rng.integers(0, 1000, 50), rng.random(50) < 0.1
        best.add(score, np.where(null, 0, doc), null)
        rows += [(i, -s, n, 0 if n else d) for (d, n, line) in zip(doc, null, score) for i, s in enumerate(line) if s > 0]
        assert len(best.item) <= 12
    want = [r for i in range(3) for r in sorted(x for x in rows if x[0] == i)[:4]]
    assert [(i, -s, n, d) for i, s, n, d in zip(best.item, best.score, best.null, best.doc)] == want


def test_numbers_beyond_64_bits():
    assert search.lengths([10**9, 1], 10**12, 10**12).tolist() == [75 + 25 * 10**9, 100]
