import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import embeddedup, neighbours

ODD = [
    (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]),
    (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [0.99, 0.01, 0.0]), (10, [0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.0]),
    (12, [1.0, 0.0]), (13, [1.0, 1e-9]), (None, [0.0, 0.0, 1.0]), (14, [1e-30, 0.0, 1e-30]), (15, [3e30, 0.0, 3e30]),
    (16, [-1.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.1]),
]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    x, y = np.array(a, dtype=float), np.array(b, dtype=float)
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / math.sqrt((x @ x) * (y @ y)))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("vector", "asks", "shard", "rank", "node", "h", "score", "usable", "label")})


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters, near copies of one vector, exact copies of another, and noise."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 24))
    x = [centres[i % 6] + rng.normal(size=24) * 0.8 for i in range(900)]
    x += [centres[0] + rng.normal(size=24) * 0.03 for _ in range(150)]
    x += [centres[1]] * 60
    x += [x[i] + rng.normal(size=24) * s for i, s in zip(range(0, 600, 3), np.linspace(0.05, 0.6, 200))]
    ids = rng.permutation(len(x) * 3)[:len(x)]
    rows = [(int(i), [float(c) for c in np.float32(v)]) for i, v in zip(ids, x)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)


def brute_nearest(rows, chosen, k):
    ids = np.array([r[0] for r in rows])
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(chosen(ids)):
        score = (u * u[q]).sum(axis=1)
        best = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in best]
    return out


@pytest.mark.parametrize("shard_rows, query_rows, candidates", [(10_000, 1000, 10_000), (300, 7, 400), (300, 1000, 60)])
def test_nearest_against_brute_force(clustered, shard_rows, query_rows, candidates):
    rows, table = clustered
    want = brute_nearest(rows, lambda ids: ids % 10 == 0, 5)
    got = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 10 == 0, candidates=candidates, shard_rows=shard_rows,
                                query_rows=query_rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    truth = {r[0]: r[1] for r in rows}
    hits = 0
    for q, best in want.items():
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine(truth[q], truth[v])) < 1e-12 for _, v, s in found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({v for _, v, _ in found} & {v for v, _ in best})
        if candidates >= shard_rows:
            assert [v for _, v, _ in found] == [v for v, _ in best]
    assert hits >= 0.9 * 5 * len(want)


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute_nearest(rows, lambda ids: ids % 50 == 0, 5)
    got = defaultdict(set)
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0, candidates=800, shard_rows=2000).collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = np.mean([len(got[q] & {v for v, _ in best}) / 5 for q, best in want.items()])
    assert recall >= 0.9


def test_forest_ascends_from_the_longest_prefix():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(500, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    forest = neighbours.Forest(rows, trees=5, bits=12)
    codes = forest.strings(rows)
    queries = rows[:20] + rng.normal(size=(20, 8)) * 0.1
    asked = forest.strings(queries)
    found = dict(forest.candidates(queries, 30))
    assert sorted(found) == list(range(20))
    for q, near in found.items():
        shared = np.array([[12 - int(x).bit_length() for x in codes[t] ^ asked[t][q]] for t in range(5)]).max(axis=0)
        level = max(p for p in range(13) if (shared >= p).sum() >= 30)
        assert near.tolist() == np.flatnonzero(shared >= level).tolist()


def test_an_id_with_different_vectors_is_found_by_the_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(7, v.tolist()) for v in np.eye(8)] * 40 + [(i, v.tolist()) for i, v in zip(range(200, 230), rng.normal(size=(30, 8)))]
    asks = [(1000 + i, (np.eye(8)[i] + 0.01).tolist()) for i in range(8)]
    table = spark.createDataFrame(rows + asks, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") >= 1000, k=5, shard_rows=100).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i, (q, v) in enumerate(asks):
        best = {}
        for j, x in rows + asks:
            if j != q:
                best[j] = max(best.get(j, -1), cosine(v, x))
        want = sorted(best, key=lambda j: (-best[j], j))[:5]
        assert [j for _, j, _ in sorted(got[q])] == want and want[0] == 7


def test_odd_vectors_search(odd):
    rows = neighbours.nearest(odd, F.lit(True), k=3).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {i: v for i, v in ODD if good(v) and i is not None}
    assert set(found) == set(usable)
    for q, near in found.items():
        others = sorted(((-cosine(usable[q], v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])))[:3]
        assert [i for i, _ in near] == [i for _, i in others]
    assert found[12] == [(13, pytest.approx(1.0))]


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, F.col("vec_id") % 50 == 0).collect() == [] and embeddedup.clusters(none).collect() == []
    alone = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(alone, F.col("vec_id") % 50 == 0).collect() == []
    assert [tuple(r) for r in embeddedup.clusters(alone).collect()] == [(50, 0, 50, True)]


def brute_groups(rows, threshold=0.9):
    ids = [r[0] for r in rows]
    near = [[good(a) and good(b) and len(a) == len(b) and i != j and cosine(a, b) >= threshold for j, (_, b) in enumerate(rows)]
            for i, (_, a) in enumerate(rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near[i][j]:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i] or -1, sum(near[i]), least.get(find(i))) for i in range(len(rows))), key=str)


def told(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in rows), key=str)


def test_odd_vectors_link(odd):
    assert told(embeddedup.clusters(odd)) == brute_groups(ODD)


def test_links_against_brute_force(clustered, monkeypatch):
    """Few rows a list and a block, so that lists, visits and blocks all occur."""
    rows, table = clustered
    monkeypatch.setattr(embeddedup, "LIST_ROWS", 80)
    monkeypatch.setattr(embeddedup, "BLOCK", 32)
    ids = [r[0] for r in rows]
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embeddedup.clusters(table).collect()}
    assert all(got[ids[i]]["n_links"] <= near[i].sum() for i in range(len(ids)))
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * near.sum() and near.sum() > 10_000


def test_no_link_is_lost_across_borders(spark, monkeypatch):
    """Vectors of low rank in many dimensions: their steps point straight across the borders of lists."""
    rng = np.random.default_rng(13)
    u = rng.normal(size=(1200, 3)) @ rng.normal(size=(3, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    monkeypatch.setattr(embeddedup, "LIST_ROWS", 60)
    monkeypatch.setattr(embeddedup, "BLOCK", 16)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddedup.clusters(table.repartition(6)).collect()}
    assert [got[i]["n_links"] for i in range(len(u))] == near.sum(axis=1).tolist()
    assert len(np.unique(np.flatnonzero(near.any(axis=1)))) > 1000


def test_visits_are_not_copied_to_disk(spark, monkeypatch):
    """Vectors that hardly cluster probe most lists; rows copied to every list went through a shuffle that outgrew the input."""
    rng = np.random.default_rng(21)
    u = rng.normal(size=(900, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u[450:600] = u[:150] + rng.normal(size=(150, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(u)] + [(1000 + i, u[3].tolist()) for i in range(40)]
    plans, write = {}, embeddedup.written

    def recorded(df, purpose):
        plans[purpose] = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        return write(df, purpose)

    monkeypatch.setattr(embeddedup, "LIST_ROWS", 60)
    monkeypatch.setattr(embeddedup, "written", recorded)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert told(embeddedup.clusters(table)) == brute_groups([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert "Exchange" not in plans["embed-links"]


def test_lookup_rules_out_no_link():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddedup.Index(x, 5)
    home, _ = index.home(x)
    codes, missed = index.encode(x, home)
    for c in range(5):
        of = np.flatnonzero(home == c)
        assert (index.lookup(x, c, codes[of]) + missed[of] >= x @ x[of].T - 1e-5).all()
