"""Language identification in two steps: the family, then linear machines between its languages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import giving_back, quoted, whole_text

# Families of languages by ISO 639-1 code. A language that is not listed is a
# family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(), "celtic": "br cy ga gd".split(), "uralic": "et fi hu se".split(),
    "turkic": "az kk ky tr tk tt ug uz".split(), "semitic": "am ar he mt".split(),
    "indic": "as bn gu hi mr ne or pa sd si ur".split(), "iranian": "fa ku ps tg".split(),
    "dravidian": "kn ml ta te".split(), "austronesian": "id jv mg ms su tl".split(),
    "sinitic": "zh".split(), "japonic": "ja".split(), "koreanic": "ko".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

UNKNOWN = "und"
#: Documents per language that the machines learn from, about so many at most.
LEARN_FROM = 400
#: Hashed features for pairs and for triples of letters.
PAIRS, TRIPLES = 1 << 11, 1 << 13
FEATURES = PAIRS + TRIPLES
#: Bytes of a text that are counted at a time.
BLOCK = 1 << 20
#: Stage of the pipeline: documents below this score go, with those of no language.
MIN_SCORE = 0.5

# Letters in lower case; all other ASCII is one kind of gap.
_FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of letter pairs and triples, at length one, with a constant at the end."""
    counts = np.zeros(FEATURES, dtype=np.float64)
    tail = np.empty(0, dtype=np.uint32)
    for at in range(0, len(text), BLOCK):
        a = np.concatenate([tail, np.frombuffer(text[at:at + BLOCK].translate(_FOLD), np.uint8)])
        # Capital letters with accents follow the byte C3 in the range 80 to 9E.
        a[np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E)) + 1] += 0x20
        new = a[max(len(tail) - 1, 0):]
        pair = (new[:-1] << 8) | new[1:]
        pair = pair[pair != 0x2020]
        counts[:PAIRS] += np.bincount((pair * np.uint32(2654435761)) >> np.uint32(21), minlength=PAIRS)
        triple = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        triple = triple[(triple & 0xFFFF) != 0x2020]
        counts[PAIRS:] += np.bincount((triple * np.uint32(2246822519)) >> np.uint32(19), minlength=TRIPLES)
        tail = a[-2:]
    out = np.sqrt(counts)
    length = np.sqrt(out @ out)
    return np.append(out / length if length else out, 1.0).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """A linear support vector machine (squared hinge loss) by dual coordinate descent; y is +1 or -1."""
    x = x.astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    # Either side weighs the same, however many documents it has.
    share = np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)) * 2 / max(len(y), 1)
    slack = share / (2 * cost)
    norm = (x * x).sum(axis=1) + slack
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                largest = max(largest, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


class Machines:
    """The learned languages, and the machines between families and between a family's languages."""

    def __init__(self, langs: list[str]) -> None:
        self.langs = sorted(langs)
        family = {lang: FAMILY_OF.get(lang, f"only {lang}") for lang in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [lang for lang in self.langs if family[lang] == f] for f in self.families}
        self.family = family
        self.pairs = [(0, a, b) for a, b in combinations(self.families, 2)]
        self.pairs += [(1, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        self.weights = np.zeros((len(self.pairs), FEATURES + 1), dtype=np.float32)

    def sides(self, lang: str) -> list[tuple[int, int]]:
        """The machines that learn from a document of ``lang``, and its side in each."""
        names = (self.family[lang], lang)
        return [(k, 1 if names[step] == a else -1) for k, (step, a, b) in enumerate(self.pairs) if names[step] in (a, b)]

    def _choose(self, step: int, among: list[str], margins: dict) -> tuple[str, float]:
        """The name that wins most of its machines, then by the larger sum; and the odds of its closest win."""
        won: dict[str, list[float]] = {name: [] for name in among}
        for a, b in combinations(among, 2):
            margin = margins[step, a, b]
            won[a].append(margin)
            won[b].append(-margin)
        best = max(among, key=lambda name: (sum(m > 0 for m in won[name]), sum(won[name]), name))
        return best, float(1 / (1 + np.exp(-2 * min(won[best], default=np.inf))))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(x)
        out = []
        for row in (x @ self.weights.T if self.pairs else np.zeros((len(x), 0))).tolist():
            margins = dict(zip(self.pairs, row))
            family, sure = self._choose(0, self.families, margins)
            lang, own = self._choose(1, self.members[family], margins)
            out.append((lang, min(sure, own)))
        return out


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(rows: DataFrame) -> DataFrame:
    """``(lang, x)`` of rows ``(lang, text)``, x as little-endian floats."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    return rows.mapInArrow(giving_back(run), "lang string, x binary")


def learn(docs: DataFrame, learn_from: int = LEARN_FROM) -> Machines:
    """Fit the machines on a bounded sample of the labelled documents that are not held out.

    About ``learn_from`` documents of each language are drawn by the hash of their row, so the
    sample is the same whatever the order. Every machine is fitted in a task of its own; a machine
    between families learns from as many documents per family as one between languages does.
    Only counts per language and the machines' weights come to the driver.
    """
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    labelled = docs.select(
        quoted("doc_id").alias("doc_id"), quoted("lang").cast("string").alias("lang"), text.alias("text")).where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}  # one row per language
    machines = Machines(list(counts))
    if not machines.pairs:
        return machines
    one = float(1 << 30)
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("learn")), F.lit(1 << 30)) / one
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, learn_from / n))])
    sample = labelled.where(drawn < share[F.col("lang")]).where(F.col("text").rlike(r"\p{L}")).select(
        "lang", F.col("text").cast("binary").alias("text"))
    sides = {lang: [(k, s) for k, s in machines.sides(lang)] for lang in machines.langs}
    thin = {k: step == 0 for k, (step, _, _) in enumerate(machines.pairs)}
    members = {lang: len(machines.members[machines.family[lang]]) for lang in machines.langs}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, machine, side = [], [], []
            for r, (lang, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for k, s in sides[lang]:
                    # The hash of the features thins the families out evenly.
                    if not thin[k] or int.from_bytes(x[:64:4], "little") % 9973 % members[lang] == 0:
                        take.append(r)
                        machine.append(k)
                        side.append(s)
            if take:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(machine, pa.int32()), pa.array(side, pa.int32()), batch.column(1).take(pa.array(take))],
                    ["machine", "side", "x"])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        raw = sorted(zip(rows["x"].to_pylist(), rows["side"].to_pylist()))  # an order of its own
        x = np.stack([np.frombuffer(r, "<f4") for r, _ in raw])
        w = train(x, np.array([s for _, s in raw], dtype=np.float64)).astype("<f4")
        return pa.table({"machine": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    dealt = _featured(sample).mapInArrow(giving_back(deal), "machine int, side int, x binary")
    for row in dealt.groupBy("machine").applyInArrow(fit, "machine int, w binary").collect():  # one row per machine
        machines.weights[row["machine"]] = np.frombuffer(row["w"], "<f4")
    return machines


def identify(docs: DataFrame, machines: Machines | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``, by its whole text alone.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or has no
    letter, and for all rows if nothing could be learned. A family of one language needs no
    machine: its score is the family's. Null ids are not held out; repeated rows have a result
    each; an empty table gives no rows. Prediction streams, without a shuffle.
    """
    told = machines or learn(docs)
    narrow = docs.select(
        quoted("doc_id").alias("doc_id"), F.when(whole_text().rlike(r"\p{L}"), whole_text()).cast("binary").alias("text"))
    return _predicted(narrow, told).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _predicted(rows: DataFrame, machines: Machines) -> DataFrame:
    """``rows`` with their last column ``text (binary)`` replaced by ``lang_pred`` and ``score``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 256):
                some = [t.as_py() for t in texts.slice(at, 256)]
                told = iter(machines.predict(np.stack([features(t) for t in some if t is not None])) if any(
                    t is not None for t in some) else [])
                found += [(UNKNOWN, 0.0) if t is None else next(told) for t in some]
            names = [*batch.schema.names[:-1], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(giving_back(run), schema)


def keep_languages(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that have no language: ``und``, or a score below ``min_score``.

    A document that wins every machine it enters scores 0.5 at least. A null ``lang`` is filled in with the predicted one;
    all other columns stay.
    """
    text = F.when(whole_text().rlike(r"\p{L}"), whole_text()).cast("binary").alias("text")
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), text)
    kept = _predicted(rows, learn(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[
        (F.coalesce(F.col("row").getField(c), F.col("lang_pred")) if c == "lang" else F.col("row").getField(c)).alias(c)
        for c in docs.columns])
