import hashlib
import random
import re
import time
from itertools import product

import numpy as np
import pytest

from fleetlens.llm import pii, tagger
from fleetlens.llm.queries import QUERIES
from fleetlens.llm.tagger import Tagger

# The patterns as the contract spells them.
PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                    13 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in twice) % 10 == 0, 9 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def listed(spans, only=None):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if only in (None, s["by"]))


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def told(big):
    return pii.learn(big)


def test_patterns_against_the_contract():
    rng = random.Random(1)
    parts = ["a", "B7", "@", ".", "..", "-", "+", " ", "4111 1111 1111 1111", "12", "255", "256", "1.2.3.4", "0.0.0.00255", "(", ")", "%", "_",
             "x.y@z.com", "+1 (974) 555-3436", "é", "日", "\n", "5105105105105100", "+", "é@x.de", "9", "a@b", "\x00"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [tuple(s) for s in pii.base_spans(text)] == brute(text), text
    assert pii.base_spans("") == []


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "1 " * 200_000, "+1" * 200_000, "+1" + ")" * 400_000,
                                  "a." * 100_000 + "@" + "b." * 100_000, "[at]" * 100_000, "0" * 400_000 + ".1.1.1"])
def test_patterns_take_linear_time(text):
    start = time.process_time()
    pii.base_spans(text)
    pii.window_starts(text)
    assert time.process_time() - start < 5


def test_patterns_in_documents(docs):
    for row in docs.select("text").collect():
        assert [tuple(s) for s in pii.base_spans(row["text"] or "")] == brute(row["text"])


def test_gradients():
    rng = np.random.default_rng(0)
    model = Tagger(2)
    model.weights = {name: w.astype(np.float64) for name, w in model.weights.items()}
    ids = rng.integers(0, tagger.ALPHABET, (5, 9))
    tags = np.array([tagger.tags_of([(0, 1, 4), (1, 5, 8)], 9), tagger.tags_of([(1, -2, 3)], 9)] * 2 + [tagger.tags_of([], 9)])
    _, grads = model.loss(ids, tags)
    for name, w in model.weights.items():
        flat = w.reshape(-1)
        for i in rng.integers(0, flat.size, 12):
            if name == "embed":
                i = ids[0, i % 9] * tagger.EMBED + i % tagger.EMBED
            at, ends = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = at + step
                ends.append(model.loss(ids, tags)[0])
            flat[i] = at
            assert abs((ends[0] - ends[1]) / 2e-3 - grads[name].reshape(-1)[i]) < 2e-4, name


def test_decoding_and_loss_against_all_paths():
    rng = np.random.default_rng(1)
    model = Tagger(1)
    model.weights["move"] = rng.normal(size=(3, 3)).astype(np.float32)
    ids = rng.integers(0, tagger.ALPHABET, (6, 5))
    emit, move = model.emissions(ids).astype(float), model.weights["move"] + model.barred
    tags, _ = model.decode(ids)
    for n in range(6):
        scores = {p: sum(emit[n, t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in product(range(3), repeat=5)}
        best = max(scores, key=scores.get)
        assert tuple(tags[n]) == best and all(a or b != 2 for a, b in zip(best, best[1:]))
        loss, _ = model.loss(ids[n:n + 1], np.array([best]))
        assert abs(loss - (np.log(sum(np.exp(s) for s in scores.values())) - scores[best])) < 1e-5


def test_tags_and_spans():
    spans = [(0, 2, 5), (0, 5, 6), (3, 8, 12)]
    assert tagger.spans_of(tagger.tags_of(spans, 12)) == spans
    assert tagger.spans_of(tagger.tags_of([(1, -3, 2), (2, 9, 20)], 12)) == [(1, 0, 2), (2, 9, 12)]
    ids = tagger.ids_of(["aé\U0001f600", ""], 4)
    assert ids.tolist() == [[97, tagger.OTHER, tagger.OTHER, tagger.PAD], [tagger.PAD] * 4]


def test_windows_are_reconciled():
    def spans(*pieces):
        return [tuple(s) for s, _ in pii.reconciled([pii.Piece(*p) for p in pieces])]

    assert spans((0, 5, 9, 3.0, False, False), (0, 5, 9, 2.0, False, False)) == [(0, 5, 9)]  # two windows, one span
    assert spans((0, 80, 96, 3.0, False, True), (0, 80, 110, 5.0, False, False)) == [(0, 80, 110)]  # cut by the first window
    assert spans((0, 48, 60, 3.0, True, False), (0, 40, 60, 5.0, False, False)) == [(0, 40, 60)]  # cut by the second
    assert spans((0, 80, 96, 3.0, False, True), (0, 80, 144, 9.0, False, True), (0, 96, 150, 2.0, True, False)) == [(0, 80, 150)]  # over three
    assert spans((0, 80, 96, 3.0, False, True)) == [] and spans((0, 48, 60, 3.0, True, False)) == []  # nobody goes on with it
    assert spans((0, 0, 10, 4.0, False, False), (1, 8, 20, 5.0, False, False), (2, 20, 30, 4.0, False, False), (0, 18, 24, 6.0, False, False)) == [
        (0, 0, 10), (0, 18, 24)]  # the largest sum without overlap
    assert spans() == []


def test_windows_hold_all_that_can_be_a_span():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "x" * 30, " ", "é", "7", "12.1.1.250", "a@b.cd", "(at)"]) for _ in range(rng.randint(0, 60)))
        starts = set(pii.window_starts(text).tolist())
        for s in range(0, max(1, len(text) - (pii.WIDTH - pii.STRIDE)), pii.STRIDE):
            window = text[s:s + pii.WIDTH]
            if len(re.findall("[0-9]", window)) >= pii.LEAST_DIGITS or pii.AT_SIGN.search(window):
                assert s in starts
        assert not starts or max(starts) + pii.WIDTH >= min(len(text), max(starts) + pii.WIDTH)


def test_finds_forms_that_the_patterns_do_not_know(big, told):
    rng = random.Random(99)
    clean = [r["text"] for r in big.where("text is not null and not text rlike '[0-9@]' and length(text) > 400").limit(300).collect()]
    assert not any(pii.scan(clean, told)[i] for i in range(len(clean)))
    found = wanted = wrong = 0
    for n, text in enumerate(clean):
        kind = n % 4
        plain = ["jo.hn%d@mail%d.example.com" % (n, n % 9), f"{n % 250}.17.{n % 99}.8", "4" + "0" * 11, f"+{1 + n % 90} ({200 + n}) 555-{1000 + n}"][kind]
        if kind == pii.CARD:
            plain += f"{n:03}"
            plain += next(c for c in "0123456789" if pii.luhn(plain + c))
        form = pii.rewritten(kind, plain, rng)
        at = text.index(" ", rng.randint(0, len(text) - 200))
        planted = f"{text[:at]} {form} {text[at + 1:]}"
        spans = pii.scan([planted], told)[0]
        wanted += 1
        found += any(s["kind"] == pii.KINDS[kind] and abs(s["start"] - at - 1) <= 1 and abs(s["end"] - at - 1 - len(form)) <= 1 for s in spans)
        wrong += any(s["end"] <= at or s["start"] > at + 1 + len(form) for s in spans)
    assert found / wanted >= 0.8 and wrong == 0, (found, wanted, wrong)


def test_leaves_figures_alone(big, told):
    rng = random.Random(98)
    clean = [r["text"] for r in big.where("text is not null and not text rlike '[0-9@]' and length(text) > 200").limit(200).collect()]
    texts = []
    for text in clean:
        at = text.index(" ", rng.randint(0, len(text) // 2))
        texts.append(f"{text[:at]} {pii.harmless(rng)} {text[at:]}")
    added = [s for spans in pii.scan(texts, told) for s in spans if s["by"] == "tagger"]
    assert len(added) <= 4


def test_a_span_is_found_wherever_it_stands(told):
    words = "this is only some text that says nothing at all about anyone and goes on for a while "
    form, hits = "john.smith (at) example (dot) com", 0
    for shift in range(0, 96, 3):
        text = (words * 3)[:100 + shift] + " " + form + " " + words * 2
        hits += any(text[s["start"]:s["end"]] == form for s in pii.scan([text], told)[0])
    assert hits >= 30  # of 32


def test_odd_rows(odd_docs, clashing_docs, no_docs, told):
    def rows(df):
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, listed(r["spans"], "pattern")) for r in pii.scan_documents(df, told).collect())

    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(r["text"]))) for r in odd_docs.collect())
    assert rows(odd_docs) == rows(clashing_docs) == want
    assert pii.learn(no_docs) is None and rows(no_docs) == []
    assert pii.learn(odd_docs.where("text is null or not text rlike '[0-9]{4}'")) is None  # nothing to learn from
    bare = pii.scan_documents(odd_docs.where("text is null"))
    assert all(r["spans"] == [] for r in bare.collect())


def test_learning_does_not_depend_on_the_order_of_rows(spark, big):
    some = big.where("text rlike '[0-9@]'").limit(300).cache()
    copies = some.unionByName(some.limit(40)).unionByName(some.limit(40))  # copies count once
    a, b, c = (pii.learn(df, learn_from=25, steps=8).to_bytes() for df in (some.repartition(5), some.repartition(2), copies.repartition(3)))
    assert a == b == c


def test_query_columns(spark, docs):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = QUERIES["op13_char_tagger_pii"](spark, sf_dir).collect()
    assert len(found) == docs.count()
    for r in found:
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        text = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(text).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(text) <= set(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
