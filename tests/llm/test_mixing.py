import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """Targets by the rule as it is told: excess over a ceiling is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: share * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    full = set()
    while over := [s for s in names if s not in full and target[s] > ceiling * sizes[s] + 1e-9]:
        excess = sum(target[s] - ceiling * sizes[s] for s in over)
        for s in over:
            target[s] = ceiling * sizes[s]
        full |= set(over)
        rest = [s for s in names if s not in full]
        if not rest:
            break
        for s in rest:
            target[s] += excess * weight[s] / sum(weight[r] for r in rest)
    return target


def check(rows, docs):
    sizes, biggest = defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d["source"]] += words(d["text"])
        biggest[d["source"]] = max(biggest[d["source"]], words(d["text"]))
    want = water_fill(dict(sizes))
    assert len(rows) == len(docs)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], words(d["text"])) for d in docs)
    assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in rows)
    assert {round(r["target"], 6) for r in rows} <= {round(t, 6) for t in want.values()}
    total = defaultdict(float)
    of = {(d["doc_id"], words(d["text"])): d["source"] for d in docs}
    for r in rows:
        total[of[r["doc_id"], r["size"]]] += r["taken"]
    return {s: abs(total[s] - want[s]) for s in want}, biggest, want


def test_targets_and_totals(docs):
    plain = [d.asDict() for d in docs.collect()]
    off, biggest, want = check(mixing.taken(mixing.decide(docs)).collect(), plain)
    assert all(off[s] <= biggest[s] for s in off)


def test_more_words_come_nearer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    off, _, want = check(mixing.taken(mixing.decide(docs)).collect(), [d.asDict() for d in docs.collect()])
    assert max(off[s] / want[s] for s in want) < 0.02


def test_levels_of_flights_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = mixing.taken(mixing.decide(docs, flight_units=8))
    two = mixing.taken(mixing.decide(docs.repartition(7), flight_units=8))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    off, biggest, _ = check(one.collect(), [d.asDict() for d in docs.collect()])
    assert all(off[s] <= biggest[s] for s in off)


def test_flight_keeps_number_and_size():
    rng = np.random.default_rng(1)
    size, chance = rng.integers(1, 500, 300), rng.random(300)
    p = mixing._flight(chance.copy(), size, rng.random(700), land=False)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert p.sum() == pytest.approx(chance.sum(), abs=1e-6) and p @ size == pytest.approx(chance @ size, abs=1e-3)


def test_flight_keeps_chances():
    size, chance = np.array([5, 9, 2, 7, 7, 1]), np.array([0.2, 0.7, 0.5, 0.35, 0.9, 0.4])
    rng = np.random.default_rng(2)
    mean = np.mean([mixing._flight(chance.copy(), size, rng.random(20), land=True) for _ in range(8000)], axis=0)
    assert np.abs(mean - chance).max() < 0.02


def test_odd_tables(odd_docs, odd_rows, no_docs, clashing_docs):
    rows = mixing.taken(mixing.decide(odd_docs)).collect()
    check(rows, [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in odd_rows])
    assert mixing.taken(mixing.decide(no_docs)).collect() == [] and mixing.mix(no_docs).collect() == []
    assert mixing.decide(clashing_docs).count() == 17


def test_mixed_rows_are_the_decided_copies(clashing_docs, odd_docs):
    for table in (clashing_docs, odd_docs):
        mixed = mixing.mix(table)
        assert mixed.columns == table.columns
        wanted = mixing.decide(table).agg(F.sum("copies")).first()[0]
        assert mixed.count() == wanted
    texts = Counter(r["text"] for r in mixing.mix(odd_docs).collect())
    decided = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.decide(odd_docs).collect()}
    assert texts["a row that repeats"] == decided[13, 4]
