from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import langid, linededup, mixing, packing, simhash
from test_packing import check


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage of the pipeline gets and gives, on the small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "/root/testdata/sf0.001").cache())
    return out


def test_stages(steps):
    docs = steps[0]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "packing"]
    assert all(s.columns == docs.columns and s.dtypes == docs.dtypes for s in steps[1:5])


def test_each_stage_against_a_plain_version(steps):
    docs, known, lines, single, mixed, packed = steps
    told = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(
        i for i, r in told.items() if r["lang_pred"] != "und" and r["score"] >= 0.5)

    from test_linededup import brute
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == brute([(d["doc_id"], d["text"]) for d in known.collect()])

    from test_simhash import brute_components, brute_fingerprint, near_pairs
    from collections import defaultdict
    by = defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: r["doc_id"]):
        by[brute_fingerprint(r["text"])].append(r["doc_id"])
    links = [(by[a][0], by[b][0]) for a, b in near_pairs(list(by))] + [(v[0], i) for v in by.values() for i in v]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(brute_components([i for v in by.values() for i in v], links).values()))

    copies = {r["doc_id"]: r["copies"] for r in mixing.decide(single).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(r["doc_id"], r["text"]) for r in single.collect()}

    share = check(packed.collect(), [(d["doc_id"], d["text"]) for d in mixed.collect()], Tokenizer.from_file(packing.vocabulary_path()))
    assert share > 0.95


def test_run_gives_the_last_stage(spark, steps):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == steps[-1].columns
    key = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.collect() if r["start"] == 0)
    assert key(rows) == key(steps[-1])
    assert linededup.line_dedup and simhash.near_dedup
