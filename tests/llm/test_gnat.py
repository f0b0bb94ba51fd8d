import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import gnat
from fleetlens.llm.queries import QUERIES

ODD = [
    (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.5, -0.25], 1), (3, [0.0, 0.0, 0.0], None), (4, None, 1), (5, [1.0, None, 0.0], 2),
    (6, [float("nan"), 1.0, 0.0], 2), (7, [float("inf"), 0.0, 0.0], 2), (8, [], None), (9, [0.99, 0.01, 0.0], 2),
    (10, [-0.3, 1.0, 0.0], 3), (11, [0.1, 1.0, 0.0], 3), (11, [0.0, 1.0, 0.0], 3), (11, [0.0, 1.0, 0.0], 3), (12, [1.0, 0.0], 3),
    (None, [0.0, -0.7, 1.0], None), (14, [1e-30, 0.0, 1e-30], 1), (16, [-1.0, 0.0, 0.0], None),
]


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Every part against every entry, in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if not kept:
        return {}, None
    width = -(-max(len(r[1]) for r in kept) // parts)
    whole = [[math.floor(scale * int(c)) if abs(c) > 2**53 else math.floor(scale * c) for c in r[1]] for r in kept]
    cut = [[(v + [0] * (parts * width))[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    by_id = {}
    for r, v, c in zip(kept, whole, cut):
        by_id[r[0]] = min(by_id.get(r[0], (v, c)), (v, c))
    first = [by_id[i][1] for i in sorted(by_id, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[c[p] for c in first] for p in range(parts)]

    def assigned(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for c in cut:
            for p in range(parts):
                members[p, assigned(p, c[p])[1]].append(c[p])
        for (p, e), some in members.items():
            books[p][e] = [sum(column) // len(some) for column in zip(*some)]
    out = defaultdict(list)
    for r, c in zip(kept, cut):
        best = [assigned(p, c[p]) for p in range(parts)]
        out[r[0]].append(("".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), 2**63 - 1)))
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    return {k: sorted(v) for k, v in out.items()}, hashlib.sha256(flat.encode()).hexdigest()


def coded(df, **how):
    books = gnat.learn(df, **how)
    out = defaultdict(list)
    for r in gnat.encode(df, books).select("row.vec_id", "code", "error").collect():
        out[r["vec_id"]].append((r["code"], r["error"]))
    return {k: sorted(v) for k, v in out.items()}, books and books.sha256()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit("x") for c in ("vector", "row", "code", "error", "part", "total", "_label")}).repartition(3)


@pytest.mark.parametrize("how", [{}, {"entries": 3, "rounds": 2}, {"parts": 2, "entries": 5}, {"rounds": 0}])
def test_odd_rows_against_brute_force(odd, how):
    assert coded(odd, **how) == brute([r[:2] for r in ODD], **how)


def test_many_rows_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16)) / 4
    x = np.float32(centres[rng.integers(0, 5, 400)] + rng.normal(size=(400, 16)) * 0.05)
    x[200:260] = x[7]  # one vector many times
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(1200)[:400], x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert coded(df) == brute(rows)


def test_large_numbers_are_exact(spark):
    rows = [(i, [x, -x / 3, 1.0, x / 7]) for i, x in enumerate([1e9, 3e15, -2e17, 5e9 + 0.5, 1e9, 7.5, 2e15, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    how = {"parts": 2, "entries": 3, "rounds": 3}
    assert coded(df, **how) == brute(rows, **how)
    beyond = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    found, _ = coded(beyond, parts=2, entries=2, rounds=1)
    assert set(found) == {1, 2, 3} and max(e for v in found.values() for _, e in v) == 2**63 - 1


def test_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    bad = spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    for df in (none, bad):
        assert gnat.learn(df) is None
        told = gnat.with_label_error(gnat.encode(df, None).select("row.vec_id", "row.label", "code", "error"))
        assert told.columns == ["vec_id", "label", "code", "error", "label_error"] and told.count() == 0


def test_errors_by_label_with_nulls_together(odd):
    rows = gnat.encode(odd, gnat.learn(odd)).select(F.col("row.vec_id"), F.col("row.label"), "row._label", "code", "error")
    told = gnat.with_label_error(rows.withColumns({"total": F.lit(1), "row": F.lit(2)})).collect()
    sums = defaultdict(int)
    for r in told:
        sums[r["label"]] += r["error"]
    assert len(told) == 13 and None in sums and all(r["label_error"] == sums[r["label"]] for r in told)


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies", "grid"])
def test_tree_finds_the_first_nearest_entry(kind):
    rng = np.random.default_rng(1)
    entries = {"spread": rng.integers(-500, 500, (16, 8)), "grid": rng.integers(0, 2, (40, 3)),
               "clustered": rng.integers(-9, 9, (64, 8)) + np.repeat(rng.integers(-5000, 5000, (8, 8)), 8, axis=0),
               "copies": np.repeat(rng.integers(-50, 50, (4, 2)), 5, axis=0)}[kind]
    near = entries[rng.integers(0, len(entries), 600)] + rng.integers(-3, 4, (600, entries.shape[1]))
    x = np.concatenate([near, rng.integers(-600, 600, (200, entries.shape[1])), entries])
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for dtype in (np.int64, object):
        best, apart, worked = gnat.nearest(gnat.grow(entries.astype(dtype)), entries.astype(dtype), x.astype(dtype))
        assert best.tolist() == d.argmin(axis=1).tolist() and apart.tolist() == d.min(axis=1).tolist()
    if kind == "clustered":  # whole subtrees go
        assert worked < 0.5 * d.size


def test_roots_never_round_the_wrong_way():
    near = np.array([0, 1, 2, 3, 4, 24, 25, 26, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 31) ** 2 + 1, (1 << 62) + 12345], dtype=np.int64)
    for squares in (near, near.astype(object)):
        low, high = gnat.roots(squares)
        for s, a, b in zip(near.tolist(), low.tolist(), high.tolist()):
            assert a == math.isqrt(s) and a * a <= s <= b * b and b - a <= 1


def test_codes_give_vectors_back(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 8))
    rows = [(i, [float(c) for c in np.float32(centres[i % 4])]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    books = gnat.learn(df, entries=4)
    for r in gnat.encode(df, books).collect():
        assert np.allclose(books.decoded(r["code"]), rows[r["row"]["vec_id"]][1], atol=1 / 4096)


def test_query_agrees_with_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(500).collect()]
    codes, sha = brute(rows, rounds=6)
    found = QUERIES["op11_gnat_codes"](spark, sf_dir).collect()
    assert {r["vec_id"]: [(r["code"], r["error"])] for r in found} == codes and {r["codebooks_sha256"] for r in found} == {sha}
