import random
import zlib

import numpy as np
import pytest

from fleetlens.llm import langid


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return {r["doc_id"]: r for r in langid.identify(docs).collect()}, {d["doc_id"]: d for d in docs.collect()}


def test_held_out_accuracy(found):
    rows, docs = found
    held = [r for r in rows.values() if r["held_out"]]
    assert len(rows) == len(docs) and len(held) > 200
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())


def test_nothing_is_learned_from_held_out_documents(spark, found):
    """Wrong labels on held-out documents change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spoiled = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang",
                              "source", "n_chars")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(spoiled.repartition(5)).collect()} == {
        i: r["lang_pred"] for i, r in found[0].items()}


def test_machine_separates_like_brute_force():
    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(size=(60, 4)), np.ones((60, 1))])
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.1, 1.0, -1.0)
    w = langid.train(x, y, cost=1000.0, rounds=2000)
    assert ((x @ w > 0) == (y > 0)).all()


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = ("Élan vital, ça va? Straße 12 " * 40).encode()
    whole = langid.features(text)
    for block in (1, 2, 17):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.allclose(langid.features(text), whole, atol=1e-6)


def test_three_languages_of_a_family(spark):
    rng = random.Random(1)
    letters = {"en": "abcdefgh", "de": "ghijklmn", "nl": "mnopqrst", "fr": "stuvwxyz", "qq": "aeiou"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(20)), lang)
            for i, lang in enumerate(list(letters) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.97


def test_odd_tables(odd_docs, odd_rows, no_docs, clashing_docs, spark):
    for table in (odd_docs, clashing_docs):
        rows = langid.identify(table).collect()
        assert len(rows) == len(odd_rows)
        told = {r["doc_id"]: r for r in rows}
        assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 for i in (1, 2, 3, 8))
        assert told[5]["lang_pred"] != "und" and told[None]["held_out"] is False
        kept = langid.keep_languages(table)
        assert kept.columns == table.columns and {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()} == set()
    assert langid.identify(no_docs).collect() == [] and langid.keep_languages(no_docs).collect() == []
    no_labels = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(no_labels).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(i, "some text", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(one).collect()} == {("en", 1.0)}
