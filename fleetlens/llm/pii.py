"""Personal data: fixed patterns, and spans that a character tagger finds in overlapping windows.

The tagger (:mod:`fleetlens.llm.tagger`) learns from the patterns' spans in a bounded sample of windows, and from
rewritten forms of them that the patterns do not know: spelled-out or spaced addresses, broken-up
numbers, phones without a plus. What it finds must also have the make-up of its kind.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import giving_back, quoted
from fleetlens.llm.tagger import Tagger, ids_of, spans_of, tags_of

# The kinds and their patterns. Possessive runs that start where a run starts find the
# same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
FOUR = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Windows per kind (and as many again without a span) that the tagger learns from, at most.
LEARN_FROM = 400
#: Characters kept around a span to learn from, characters a lesson has, and steps of learning.
CONTEXT, LESSON, STEPS = 56, 64, 360
#: Characters of a window, and from one window to the next.
WIDTH, STRIDE = 96, 48
#: Windows decoded at a time, and characters looked at for digits at a time.
WINDOWS, PIECE = 512, 1 << 20
#: Parts of a kind's sampled windows that are thinned apart before the last choice.
SALTS = 16

AT_SIGN = re.compile(r"@|[(\[{]\x20?at\x20?[)\]}]", re.IGNORECASE)
#: Every span of a kind with numbers holds this many digits, so windows with fewer hold none.
LEAST_DIGITS = 4

# What a tagged span must look like. Wider than the patterns above; the checksum and number ranges are checked besides.
_DOT = r"(?:\x20?\.\x20?|\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?|\x20dot\x20)"
MADE_OF = {
    EMAIL: re.compile(rf"[\w.%+-]+\x20?(?:@|[(\[{{]\x20?at\x20?[)\]}}])\x20?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}", re.IGNORECASE),
    IP: re.compile(r"([0-9]{1,3})(?:\[\.\]|\(\.\)|\{\.\}|\x20?\.\x20?)([0-9]{1,3})(?:\[\.\]|\(\.\)|\{\.\}|\x20?\.\x20?)"
                   r"([0-9]{1,3})(?:\[\.\]|\(\.\)|\{\.\}|\x20?\.\x20?)([0-9]{1,3})"),
    CARD: re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}"),
    PHONE: re.compile(r"(?:\+|00)?\x20?\(?[0-9]{1,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,5}"),
}
DATE = re.compile(r"(?:[12][0-9]{3}([./-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([./-])[0-3]?[0-9]\2(?:[12][0-9])?[0-9]{2})")

SPANS = "array<struct<kind: string, start: long, end: long, by: string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by", pa.string())]))


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if place % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[Span]:
    """Sign by sign: what stands before it back to the last match, and the domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        stop = NOT_LOCAL.search(text[last:at][::-1]) if domain else None
        start = last if stop is None else at - stop.start()
        # Nothing before this sign is wanted again: no local part holds a sign.
        last = at + 1
        if domain and start < at:
            yield Span(EMAIL, start, domain.end())
            last = domain.end()
        at = text.find("@", last)


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """The patterns' spans, by kind and start. Unchecked, card numbers need only have a card's length."""
    if not text:
        return []
    out = list(emails(text))
    out += [Span(IP, m.start(), m.end()) for m in FOUR.finditer(text) if all(map(_small, m.groups()))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m.group())
            if 13 <= len(digits) <= 19 and (not checked or luhn(digits)):
                out.append(Span(CARD, m.start(), m.end()))
    if "+" in text:
        out += [Span(PHONE, m.start(), m.end()) for m in DIALLED.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# Lessons

def rewritten(kind: int, span: str, rng: random.Random) -> str:
    """The same datum in a form that the patterns do not know, or not as one span."""
    if kind == EMAIL:
        local, domain = span.split("@")
        sign = rng.choice([" @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", "@"])
        dot = rng.choice([".", " . ", "(dot)", " (dot) ", "[dot]", " dot ", "[.]"])
        return local + sign + domain.replace(".", dot)
    if kind == IP:
        return span.replace(".", rng.choice(["[.]", "(.)", " . ", "{.}"]))
    digits = digits_of(span)
    if kind == CARD:
        return rng.choice([" ", "-", ".", "/", "  ", ""]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    code, rest = digits[:-10], digits[-10:]
    a, b, c = rest[:-7], rest[-7:-4], rest[-4:]
    sep = rng.choice("-. /")
    return rng.choice([f"({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}", f"00{code or 1}{sep}{a}{sep}{b}{sep}{c}", f"0{a}/{b}{c}",
                       f"+{code or 1} {a} {b} {c}", f"({a}) {b} {c}"])


def harmless(rng: random.Random) -> str:
    """Figures and signs that are no personal data: dates, times, versions, prices, digests, long numbers."""
    def some(n: int, of: str = "0123456789") -> str:
        return "".join(rng.choice(of) for _ in range(n))

    return rng.choice([
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}", lambda: f"{rng.randint(0, 23)}:{some(2)}:{some(2)}",
        lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{some(3)}",
        lambda: f"${some(3)},{some(3)}.{some(2)}", lambda: some(rng.randint(20, 40)), lambda: some(rng.randint(1, 8)),
        lambda: some(40, "0123456789abcdef"), lambda: some(32, "0123456789ABCDEF"), lambda: f"{some(4)}-{some(4)}",
        lambda: f"{some(1)} {some(3)} {some(3)}", lambda: f"{some(4)} x {some(4)}", lambda: f"@{some(6, 'abcdefgh')}",
        lambda: f"{some(3)}.{some(4)}.{some(1)}", lambda: f"#{some(6)}", lambda: f"{some(8, 'abcdef0123456789')}-{some(4)}-{some(4)}"])()


def lessons(windows: list[tuple[str, list[Span]]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers and tags: each window as it is, and each with a span with that span rewritten and replaced."""
    rng = random.Random(seed)
    texts: list[str] = []
    tags: list[np.ndarray] = []

    def learn(text: str, spans: list[Span]) -> None:
        # Somewhere around one of the spans, or anywhere.
        middle = (lambda s: (s.start + s.end) // 2)(rng.choice(spans)) if spans else rng.randint(0, len(text))
        at = max(0, min(middle - rng.randint(8, LESSON - 8), len(text) - LESSON // 2))
        texts.append(text[at:at + LESSON])
        tags.append(tags_of([(s.kind, s.start - at, s.end - at) for s in spans], LESSON))

    def replaced(text: str, spans: list[Span], one: Span, by: str, kind: int | None) -> None:
        moved = [Span(s.kind, s.start + d, s.end + d) for s in spans if s is not one and (s.end <= one.start or s.start >= one.end)
                 for d in [len(by) - (one.end - one.start) if s.start >= one.end else 0]]
        learn(text[:one.start] + by + text[one.end:], moved + ([Span(kind, one.start, one.start + len(by))] if kind is not None else []))

    for text, spans in windows:
        learn(text, spans)
        whole = [s for s in spans if s.start >= 0 and s.end <= len(text)]  # neighbours may be cut
        if whole:
            one = rng.choice(whole)
            for _ in range(2):
                replaced(text, spans, one, rewritten(one.kind, text[one.start:one.end], rng), one.kind)
            replaced(text, spans, one, harmless(rng), None)
    return ids_of(texts, LESSON), np.array(tags)


def _sampled(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The windows of a task with the smallest hashes: of each kind ``most``, and so many without a span."""
    few: list[dict[int, tuple[str, str]]] = [{} for _ in range(len(KINDS) + 1)]
    limit = [1 << 63] * len(few)

    def offer(kind: int, text: str, spans: list[Span]) -> None:
        h = xxhash.xxh64_intdigest(text) >> 1  # the same order as a signed long
        if h < limit[kind]:
            row = (text, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans))
            few[kind][h] = min(few[kind].get(h, row), row)
            if len(few[kind]) >= 2 * most:
                few[kind] = dict(sorted(few[kind].items())[:most])
                limit[kind] = max(few[kind])

    for batch in batches:
        for raw in batch.column(0):
            text = raw.as_py() or ""
            if not (re.search("[0-9@]", text)):
                continue
            spans = sorted(base_spans(text, checked=False), key=lambda s: (s.start, -s.end))
            apart: list[Span] = []  # one tag per character: what begins first counts
            for s in spans:
                if not apart or s.start >= apart[-1].end:
                    apart.append(s)
            for i, s in enumerate(apart):
                a, b = max(0, s.start - CONTEXT), s.end + CONTEXT
                near = [t for t in apart[max(0, i - 8):i + 9] if t.end > a and t.start < b]
                offer(s.kind, text[a:b], [Span(t.kind, t.start - a, t.end - a) for t in near])
            at = 0
            for m in re.finditer("[0-9@]", text):
                if m.start() >= at:  # a window around it, unless a span is near
                    a, at = max(0, m.start() - CONTEXT), m.start() + 2 * CONTEXT
                    i = bisect_right(apart, a, key=lambda s: s.end)
                    if i == len(apart) or apart[i].start >= at:
                        offer(len(KINDS), text[a:at], [])
    rows = [(kind, h, *row) for kind, found in enumerate(few) for h, row in sorted(found.items())[:most]]
    if rows:
        kind, h, text, spans = zip(*rows)
        yield pa.RecordBatch.from_arrays([
            pa.array(kind, pa.int32()), pa.array(h, pa.int64()), pa.array(text, pa.string()),
            pa.array(spans, pa.string())], ["kind", "h", "text", "spans"])


def learn(docs: DataFrame, text: str = "text", learn_from: int = LEARN_FROM, steps: int = STEPS) -> Tagger | None:
    """A tagger fitted on windows around the patterns' spans; None if no text has a span.

    One pass over the texts: each task hands over the ``learn_from`` windows of each kind, and of none, whose
    texts have the smallest hashes, copies once; of all these the smallest are taken again. The sample does not
    depend on the order of rows. It has at most five times ``learn_from`` windows of some hundred characters (more
    where a span is longer), which one task learns from; the weights come to the driver.
    """
    narrow = docs.select(quoted(text).cast("string").alias("text"))
    offered = narrow.mapInArrow(giving_back(lambda batches: _sampled(batches, learn_from)), "kind int, h long, text string, spans string")
    one = offered.groupBy("kind", "h").agg(F.min(F.struct("text", "spans")).alias("row"))
    part = F.pmod(F.col("h"), F.lit(SALTS))
    some = one.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("kind", "part").orderBy("h")))
    last = some.where(F.col("n") <= learn_from).withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("h")))
    sample = last.where(F.col("n") <= learn_from).select(F.lit(0).alias("one"), "kind", "h", "row.text", "row.spans")

    def fit(rows: pa.Table) -> pa.Table:
        windows = []
        for row in sorted(rows.select(["kind", "h", "text", "spans"]).to_pylist(), key=lambda r: (r["kind"], r["h"])):
            spans = [Span(*map(int, s.split(":"))) for s in row["spans"].split(",") if s]
            windows.append((row["text"], spans))
        if not any(spans for _, spans in windows):
            return pa.table({"weights": pa.array([], pa.binary())})
        tagger = Tagger(len(KINDS))
        tagger.fit(*lessons(windows), steps=steps)
        return pa.table({"weights": pa.array([tagger.to_bytes()], pa.binary())})

    fitted = sample.groupBy("one").applyInArrow(fit, "weights binary").collect()  # one row
    return Tagger.from_bytes(bytes(fitted[0]["weights"]), len(KINDS)) if fitted else None


# Tagging whole texts

def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that can hold a span: on a fixed grid, with a sign or enough digits in or near them."""
    signs = np.array([m.start() for m in AT_SIGN.finditer(text)], dtype=np.int64)
    digits = [np.empty(0, dtype=np.int64)]
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        digits.append(np.flatnonzero((code >= 48) & (code <= 57)) + at)
    digit = np.concatenate(digits)
    starts = np.arange(0, max(1, len(text) - (WIDTH - STRIDE)), STRIDE)
    low, high = starts - STRIDE // 2, starts + WIDTH + STRIDE // 2
    enough = np.searchsorted(digit, high) - np.searchsorted(digit, low) >= LEAST_DIGITS
    return starts[enough | (np.searchsorted(signs, high) > np.searchsorted(signs, low))]


class Piece(NamedTuple):
    """A span as one window has it; open where the window ends but the text does not."""

    kind: int
    start: int
    end: int
    score: float
    open_left: bool
    open_right: bool


def reconciled(pieces: list[Piece]) -> list[tuple[Span, float]]:
    """One set of spans that do not overlap, from all windows of a text.

    Pieces of a kind that a window's border cuts are joined with what the next window has of them; a cut
    piece that no other window goes on with is dropped, since the window that holds its surroundings does not see
    it. Of the rest the set with the largest sum of scores is taken.
    """
    whole: dict[Span, float] = {}
    run: Piece | None = None
    for piece in [*sorted(pieces), None]:
        if run and piece and piece.kind == run.kind and piece.start < run.end and (
                piece.open_left or run.open_right or piece.end <= run.end):
            left = run.open_left and (piece.start > run.start or piece.open_left)
            right = piece.open_right and (piece.end > run.end or run.open_right) if piece.end >= run.end else run.open_right
            run = Piece(run.kind, run.start, max(run.end, piece.end), max(run.score, piece.score), left, right)
            continue
        if run and not run.open_left and not run.open_right:
            span = Span(run.kind, run.start, run.end)
            whole[span] = max(whole.get(span, 0.0), run.score)
        run = piece
    ranked = sorted(whole.items(), key=lambda kv: (kv[0].end, kv[0].start, kv[0].kind))
    ends = [span.end for span, _ in ranked]
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)]  # sum, this span taken, state before it
    for i, (span, score) in enumerate(ranked):
        before = bisect_right(ends, span.start, 0, i)
        taken = best[before][0] + score
        best.append((taken, i, before) if taken > best[i][0] else (best[i][0], -1, i))
    out, at = [], len(ranked)
    while at > 0:
        _, taken, before = best[at]
        if taken >= 0:
            out.append(ranked[taken])
        at = before
    return out[::-1]


def settled(text: str, span: Span) -> Span | None:
    """The span with its borders on the datum's own characters, if it has the make-up of its kind."""
    kind, start, end = span
    inner = (lambda c: c.isalnum()) if kind == EMAIL else (lambda c: "0" <= c <= "9")
    opening = "" if kind == EMAIL else "+(" if kind == PHONE else ""
    while start < end and not inner(text[start]) and text[start] not in opening:
        start += 1
    while end > start and not inner(text[end - 1]):
        end -= 1
    while start > 0 and inner(text[start - 1]):
        start -= 1
    while end < len(text) and inner(text[end]):
        end += 1
    if kind == PHONE and start > 0 and text[start - 1] in "+(":
        start -= 1
        if start > 0 and text[start] == "(" and text[start - 1] == "+":
            start -= 1
    some = text[start:end]
    made = MADE_OF[kind].fullmatch(some) if start < end else None
    if not made:
        return None
    if kind != EMAIL and ((start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())):
        return None
    digits = digits_of(some)
    good = {EMAIL: True, IP: kind == IP and all(map(_small, made.groups())), CARD: luhn(digits),
            PHONE: 7 <= len(digits) <= 15 and not DATE.fullmatch(some) and (len(digits) > 8 or some[0] in "+(0")}[kind]
    return Span(kind, start, end) if good else None


def tagged(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """What the tagger finds in each text, whole and settled."""
    pieces: list[list[Piece]] = [[] for _ in texts]
    waiting: list[tuple[int, int]] = []

    def decode() -> None:
        tags, above = tagger.decode(ids_of([texts[t][s:s + WIDTH] for t, s in waiting], WIDTH))
        for row in np.flatnonzero(tags.any(axis=1)):
            t, s = waiting[row]
            for kind, a, b in spans_of(tags[row]):
                b = min(b, len(texts[t]) - s)
                if a < b:
                    cut = (a == 0 and s > 0 and tags[row, 0] % 2 == 0, b == WIDTH and s + b < len(texts[t]))
                    pieces[t].append(Piece(kind, s + a, s + b, float(above[row, a:b].mean()) * (b - a), *cut))
        waiting.clear()

    for t, text in enumerate(texts):
        for s in window_starts(text).tolist():
            waiting.append((t, s))
            if len(waiting) == WINDOWS:
                decode()
    if waiting:
        decode()
    found = []
    for text, some in zip(texts, pieces):
        spans = {made for span, _ in reconciled(some) if (made := settled(text, span)) is not None}
        found.append(sorted(spans))
    return found


def scan(texts: list[str | None], tagger: Tagger | None) -> list[list[dict]]:
    """All spans of each text, by kind as listed and then start; code points, end exclusive.

    The patterns' spans are all there. The tagger adds what overlaps none of them.
    """
    plain = [text or "" for text in texts]
    found = [base_spans(text) for text in plain]
    some = [t for t, text in enumerate(plain) if tagger and re.search(r"[0-9]|" + AT_SIGN.pattern, text, re.IGNORECASE)]
    more = dict(zip(some, tagged([plain[t] for t in some], tagger) if some else []))
    out = []
    for t, base in enumerate(found):
        taken = sorted((s.start, s.end) for s in base)
        rows = [(*s, "pattern") for s in base]
        for span in more.get(t, []):
            if not any(a < span.end and b > span.start for a, b in taken[max(0, bisect_right(taken, (span.start, 0)) - len(KINDS)):
                                                                          bisect_right(taken, (span.end, 0))]):
                rows.append((*span, "tagger"))
        out.append([{"kind": KINDS[kind], "start": start, "end": end, "by": by} for kind, start, end, by in sorted(rows)])
    return out


def scan_documents(docs: DataFrame, tagger: Tagger | None = None, learn_from: int = LEARN_FROM) -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs``; spans have kind, start, end and whether pattern or tagger found them.

    Without a ``tagger`` one is learned from the texts first. A null text counts as empty; whole texts are
    read, in overlapping windows, whatever their length; ids may be null or repeat, and repeated rows have a
    result each; other columns are not read; an empty table gives no rows. No shuffle but that of the sample.
    """
    told = tagger or learn(docs, learn_from=learn_from)
    narrow = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan(batch.column(1).to_pylist(), told)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])

    return narrow.mapInArrow(giving_back(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
