"""Secret scans: fixed patterns, and literals that are assigned to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import giving_back, quoted

# The kinds and their patterns. A bound on a whole run of a class is part of the
# pattern, which then finds the same runs.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "literal")

# Parts of names that hold secrets, with how much such a name tells.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "signature": 0.7, "auth": 0.7, "pass": 0.8,
}
#: ``key`` alone says little; with one of these before it, it is a secret.
KEY_OF = {"api", "access", "private", "secret", "encryption", "signing", "master", "account", "storage", "auth"}
STEMS = ("passw", "pwd", "passphrase", "passcode", "secret", "token", "key", "credential", "bearer", "signature", "auth",
         "pass")
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|none|null|nil|undefined|true|false|changeme|change_me|example.*|test|dummy|redacted|"
    r"your[_ -].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|os\.environ.*|process\.env.*|getenv.*)$")

#: A type between a name and its sign: ``str``, ``string | null``, ``Optional[str]``, ``&'static str``.
_TYPE = r"[A-Za-z_](?:[\w.?*]|::|\[[^:=;\n]*\]|<[^:=;\n]*>)*+"
_TYPED = (rf"[?!]?[ \t]*+:[ \t]*+(?:&(?:'\w++\x20)?(?:mut\x20)?)?{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*+"
          r"(?=[ \t]++=[ \t]*+[\"'A-Za-z_]|=[ \t]*+[\"'])")
#: A name, an assignment sign and what follows it, in source and configuration syntax: ``x = "v"``,
#: ``x: v``, ``"x": "v"``, ``x := v``, ``x => v``, ``export X=v``, ``x: str = "v"``, ``env["x"] = "v"``. A name
#: starts where no name goes on, and takes all it can, so every character is looked at a bounded number of times.
STATEMENT = re.compile(
    r"""(?<![\w.\-])["']?(?P<name>[A-Za-z_][\w.\-]*+)(?:["'](?:[ \t]*+\])?)?(?:""" + _TYPED + r""")?"""
    r"""[ \t]*+(?:=>|:=|=(?!=)|:(?!//))[ \t]*+"""
    r"""(?P<value>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[^\s,;"'(){}\[\]<>]++)""")
MORE = re.compile(r"""[ \t]*+\+[ \t]*+("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[A-Za-z_][\w.]*+)""")
OPERAND = re.compile(r"[^+]++")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
THRESHOLD = 0.6

SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


class Literal(NamedTuple):
    text: str
    start: int
    end: int


def sensitivity(name: str) -> float:
    """How much a target name says that its value is secret, 0 to 1."""
    parts = [p.lower() for p in CAMEL.findall(name.rsplit(".", 1)[-1])]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    pairs = set(zip(parts, parts[1:]))
    if any(b in ("key", "keys") and a in KEY_OF for a, b in pairs):
        best = 1.0
    if any(a + b == "apikey" or a + b == "passphrase" for a, b in pairs):
        best = 1.0
    return best


class Value:
    """What a name was given: literals, or the values that it is put together of, by reference.

    Character counts, the length and the ends are carried along, so a value that stands for many
    literals is scored without putting its text together.
    """

    __slots__ = ("parts", "counts", "size", "head", "tail", "best")

    def __init__(self, parts: list[Literal | Value]) -> None:
        self.parts, self.best = parts, 0.0
        self.counts: dict[str, float] = {}
        self.size, self.head, self.tail = 0, "", ""
        for part in parts:
            if isinstance(part, Literal):
                counts, size, head, tail = Counter(part.text), len(part.text), part.text[:64], part.text[-64:]
            else:
                counts, size, head, tail = part.counts, part.size, part.head, part.tail
            for c, n in counts.items():
                self.counts[c] = self.counts.get(c, 0.0) + n
            if len(self.head) < 64:
                self.head = (self.head + head)[:64]
            self.size, self.tail = self.size + size, (self.tail + tail)[-64:]
        if self.size > 1 << 40:  # of names that double again and again; only shares matter
            self.counts, self.size = {c: n / self.size * (1 << 20) for c, n in self.counts.items()}, 1 << 20

    def score(self) -> float:
        """How much the whole looks like a secret: long, varied, and no placeholder."""
        # Placeholders are told by their ends and by which characters stand between.
        known = self.head if self.size <= 64 else self.head + "".join(self.counts) + self.tail
        if self.size < 6 or PLACEHOLDER.match(known) or any(c.isspace() for c in self.counts):
            return 0.0
        total = sum(self.counts.values())
        entropy = -sum(n / total * math.log2(n / total) for n in self.counts.values())
        kinds = sum(any(map(test, self.counts)) for test in (str.islower, str.isupper, str.isdigit)) + any(
            not c.isalnum() for c in self.counts)
        return min(1.0, 0.25 + 0.5 * min(1.0, entropy / 3.5) + 0.1 * (kinds - 1) + 0.15 * (self.size >= 12))


def literal_score(text: str) -> float:
    """How much a literal looks like a secret."""
    return Value([Literal(text, 0, len(text))]).score()


def assigned(text: str) -> Iterator[tuple[str, Value]]:
    """Every assignment of a text, in order, as a name and the value that it is given.

    Names that were given literals before stand for them, so constants propagate.
    """
    known: dict[str, Value] = {}
    for found in STATEMENT.finditer(text):
        pieces, at = [found.span("value")], found.end()
        while (more := MORE.match(text, at)) is not None:
            pieces.append(more.span(1))
            at = more.end()
        start, end = pieces[0]
        if text[start] not in "\"'" and "+" in text[start:end]:
            # In an unquoted value a plus joins known names, or names and a quoted part; else it is a character of it.
            names = [m.span() for m in OPERAND.finditer(text, start, end)]
            if text[end - 1] == "+" and text[end:end + 1] in ("'", '"') and (more := MORE.match(text, end - 1)) is not None:
                pieces, at = [*names, more.span(1)], more.end()
                while (more := MORE.match(text, at)) is not None:
                    pieces.append(more.span(1))
                    at = more.end()
            else:
                of = [text[a:b] in known for a, b in names]
                if all(of):
                    pieces[:1] = names
                elif any(of):  # either may be meant
                    yield found["name"], Value([known[text[a:b]] for (a, b), k in zip(names, of) if k])
        parts: list[Literal | Value] = []
        for start, end in pieces:
            raw = text[start:end]
            if raw[0] in "\"'":
                parts.append(Literal(raw[1:-1], start + 1, end - 1))
            elif raw in known:
                parts.append(known[raw])
            elif len(pieces) == 1:
                parts.append(Literal(raw, start, end))
        name = found["name"]
        if parts:
            known[name] = Value(parts)
            yield name, known[name]


def added_spans(text: str) -> Iterator[tuple[int, int, float]]:
    """Literals that reach a sensitive name, with name and literal scored together."""
    values: dict[int, Value] = {}
    for name, value in assigned(text):
        values[id(value)] = value
        weight = sensitivity(name)
        if weight:
            score = round(weight * value.score(), 4)
            if score >= THRESHOLD:
                value.best = max(value.best, score)
    # From the last value to the first each hands its score to its parts, so all are met once.
    seen: dict[tuple[int, int], float] = {}
    for value in reversed(values.values()):
        for part in value.parts if value.best else ():
            if isinstance(part, Value):
                part.best = max(part.best, value.best)
            elif part.start < part.end:
                key = (part.start, part.end)
                seen[key] = max(seen.get(key, 0.0), value.best)
    for (start, end), score in seen.items():
        yield start, end, score


def scan(text: str | None) -> list[dict]:
    """All spans of a text, by start and then kind as listed; code points, end exclusive."""
    if not text:
        return []
    spans: list[tuple[int, int, int, float]] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end(), 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), 1.0) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), 1.0) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text) and any(stem in low for stem in STEMS):
        # An added span within one of the patterns' spans tells nothing new.
        base = sorted((start, end) for start, _, end, _ in spans)
        at, reach = 0, -1
        for start, end, score in sorted(added_spans(text)):
            while at < len(base) and base[at][0] <= start:
                reach = max(reach, base[at][1])
                at += 1
            if end > reach:
                spans.append((start, 3, end, score))
    return [{"kind": KINDS[kind], "start": start, "end": end, "score": score}
            for start, kind, end, score in sorted(spans)]


def scan_documents(docs: DataFrame) -> DataFrame:
    """``docs``' ids and the secrets in their whole texts: ``(doc_id, spans)``.

    ``spans`` has kind, start, end and score, by start and then kind. The patterns' spans are
    all kept, with score 1; ``literal`` spans come from assignments. A null text counts as empty;
    ids may be null or repeat; an empty table gives no rows. No shuffle.
    """
    narrow = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])

    return narrow.mapInArrow(giving_back(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mark``; overlapping spans as one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([_redacted(t.as_py(), mark) for t in batch.column(at)],
                                                        batch.schema.field(at).type))

    return docs.mapInArrow(giving_back(run), docs.schema)


def _redacted(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for span in scan(text):
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at:span["start"]], mark]
        at = span["end"]
    return "".join(out) + text[at:]


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
