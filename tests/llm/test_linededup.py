import random
from collections import defaultdict

from fleetlens.llm import linededup
from llm_helpers import sentence


def brute(rows):
    """Chunks by the same boundaries; all but the first place of equal bytes go."""
    places = defaultdict(set)
    for doc_id, text in rows:
        for line, chunk in linededup.chunks((text or "").encode()):
            places[chunk].add((doc_id, line))
    gone = defaultdict(set)
    for found in places.values():
        for doc_id, line in sorted(found)[1:]:
            gone[doc_id].add(line)
    return {d: t if d not in gone else linededup.without(t.encode(), list(gone[d])).decode() for d, t in rows}


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in linededup.line_dedup(docs.repartition(4)).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    return {d: r["text"] for d, r in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(7)
    pool = ["\n".join(sentence(rng, rng.randint(2, 9)) for _ in range(rng.randint(4, 9))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [sentence(rng, rng.randint(1, 70)) for _ in range(rng.randint(0, 9))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(pool))
        rows.append((i, "\n".join(parts)))
    got = run(spark, rows)
    assert got == brute(rows) and any(got[d] != t for d, t in rows)


def test_real_documents(spark, docs):
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    assert run(spark, rows) == brute(rows)


def test_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(3)
    passage = sentence(rng, 60)
    several = "\n".join(sentence(rng, 12) for _ in range(30))
    clean = {i: "\n".join(sentence(rng, 14) for _ in range(8)) for i in range(30)}
    rows = [(i, t) for i, t in clean.items()]
    for i in range(10, 20):
        lines = clean[i].split("\n")
        rows[i] = (i, "\n".join([*lines[:i % 8], passage if i % 2 else several, *lines[i % 8:]]))
    got = run(spark, rows)
    assert all(got[i] == t for i, t in clean.items() if not 10 <= i < 20)
    assert passage in got[11] and all(passage not in got[i] for i in range(13, 20, 2))
    assert several in got[10]
    assert all(len(got[i]) < len(clean[i]) + len(several) / 3 for i in range(12, 20, 2))


def test_boundaries_do_not_shift():
    rng = random.Random(5)
    lines = [sentence(rng, 5).encode() for _ in range(300)]
    one = set(linededup.boundaries(lines)[0].tolist())
    two = {s - 3 for s in linededup.boundaries([b"x", b"y", b"z", *lines])[0].tolist()}
    assert {s for s in one if s > linededup.WINDOW} == {s for s in two if s > linededup.WINDOW}


def test_odd_tables(odd_docs, no_docs, clashing_docs):
    for table in (odd_docs, clashing_docs):
        out = linededup.line_dedup(table)
        assert out.columns == table.columns and out.count() == table.count()
        assert sorted((r["doc_id"] or 0, r["text"] is None) for r in out.collect()) == sorted(
            (r["doc_id"] or 0, r["text"] is None) for r in table.collect())
    assert linededup.line_dedup(no_docs).collect() == []
