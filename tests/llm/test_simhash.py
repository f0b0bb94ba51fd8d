import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fleetlens.llm import components, simhash


def brute_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in items}


def near_pairs(fps, bits=3):
    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits):
            yield fps[i], fps[i + 1 + int(j)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two words", "ÉCLAIR Éclair A\x0bB\x0cc", "a b c", "a b c d " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_fingerprint_of_long_texts_in_blocks(monkeypatch):
    rng = random.Random(2)
    text = "  ".join("".join(rng.choice("abcXYZé") for _ in range(rng.randint(1, 9))) for _ in range(900))
    for block in (1, 7, 100):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("run", [4096, 6, 2])
def test_links_connect_as_brute_force(spark, run):
    """Dense and sparse neighbourhoods; small runs force the finer variants of the second and third level."""
    rng = random.Random(run)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centres) | {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    for c in centres:
        for _ in range(40):
            x = c
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps, key=signed)
    rows = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(5)
    edges = [(r["a"], r["b"]) for r in simhash.links(rows, run=run).collect()]
    items = [signed(x) for x in fps]
    want = brute_components(items, [(signed(a), signed(b)) for a, b in near_pairs(fps)])
    assert brute_components(items, edges) == want
    got = {r["node"]: r["root"] for r in components.components(
        simhash.links(rows, run=run)).collect()}
    assert {i: got.get(i, i) for i in items} == want


@pytest.mark.parametrize("run", [4096, 100])
def test_links_of_a_dense_ball(spark, run, monkeypatch):
    """All fingerprints within two bits of one: many share every variant, and links are stars, not pairs."""
    monkeypatch.setattr(simhash, "HELD_PAIRS", 1000)
    fps = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    rows = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.links(rows, run=run)
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    least = min(signed(x) for x in fps)
    assert all(found.get(signed(x), signed(x)) == least for x in fps)
    if run == 4096:
        assert edges.count() < 64 * len(fps)


def test_components_against_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(140)] + [(7, 7), (7, 7)]
    edges += [(1000, 1001 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(200)]
    items = sorted({x for e in edges for x in e})
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in items} == brute_components(items, edges)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs.collect()}
    by = defaultdict(list)
    for i, fp in sorted(plain.items()):
        by[fp].append(i)
    links = [(by[a][0], by[b][0]) for a, b in near_pairs(list(by))] + [(v[0], i) for v in by.values() for i in v]
    want = brute_components(sorted(plain), links)
    rows = simhash.clusters(docs).collect()
    assert {r["doc_id"]: r["fp"] for r in rows} == {i: signed(fp) for i, fp in plain.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    kept = sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect())
    assert kept == sorted(set(want.values()))


def test_odd_tables(odd_docs, odd_rows, no_docs, clashing_docs):
    for table in (odd_docs, clashing_docs):
        rows = simhash.clusters(table).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
        blank = [r for r in rows if r["doc_id"] in (1, 2, 3)]
        assert {(r["fp"], r["component_id"]) for r in blank} == {(0, 1)}
        assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
        kept = simhash.near_dedup(table)
        assert kept.columns == table.columns
        ids = Counter(r["doc_id"] for r in kept.collect())
        assert ids[13] == 1 and ids[6] == 1 and ids[7] == 0 and ids[1] == 1 and ids[2] == 0 and ids[14] == 2
    assert simhash.clusters(no_docs).collect() == [] and simhash.near_dedup(no_docs).collect() == []
