"""Alert rules and connection state on a stream: what a drone does, and what it stops doing.

Rules are judged at ticks of event time, by a drone's last sample at or before the tick, like the batch form
in :mod:`fleetlens.plans.rules`. A tick is judged when the watermark has reached it, for then all records
before it are there. Timers of event time wake a drone that sends nothing, so silence is noticed without input.
A drone's timer is set to the next tick at which anything can change, not to every tick.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.fleet import ACTIVE_S
from fleetlens.operators.series import LOOKBACK_S, SCRAPE_S, SECOND, STEP_S
from fleetlens.operators.windows import WATERMARK
from fleetlens.plans.rules import Rule

SILENCE = "seconds since the last record"
FORGET_S = 86_400
_NEVER = -1
_COMPARE = {"<": np.less, ">": np.greater, "==": np.equal, ">=": np.greater_equal}


class Watch(NamedTuple):
    """A rule and the telemetry field it judges; ``SILENCE`` judges the time since the drone's last record.

    ``stale_s``: a sample this old counts as 0, as a connection gauge does.
    """

    alert: str
    field: str
    op: str
    threshold: float
    for_s: int
    stale_s: int | None = None

    @classmethod
    def of(cls, rule: Rule, field: str, stale_s: int | None = None) -> Watch:
        return cls(rule.alert, field, rule.op, rule.threshold, rule.for_s, stale_s)


def silence(alert: str, silent_s: int) -> Watch:
    """A watch for drones that have sent nothing for so long."""
    return Watch(alert, SILENCE, ">=", float(silent_s), 0)


class Samples(NamedTuple):
    """Samples of all fields, by field and time: ``at`` is when a sample is taken, ``us`` and ``tie`` order the
    records of one interval."""

    field: np.ndarray
    at: np.ndarray
    us: np.ndarray
    tie: np.ndarray
    value: np.ndarray

    def newest(self) -> Samples:
        """One sample per field and time, the last record's."""
        order = np.lexsort((self.tie, self.us, self.at, self.field))
        s = Samples(*(x[order] for x in self))
        last = np.ones(len(order), dtype=bool)
        last[:-1] = (s.field[1:] != s.field[:-1]) | (s.at[1:] != s.at[:-1])
        return s.where(last)

    def where(self, rows: np.ndarray) -> Samples:
        return Samples(*(x[rows] for x in self))

    def and_(self, other: Samples) -> Samples:
        return Samples(*(np.concatenate(pair) for pair in zip(self, other)))


def judged(watch: Watch, ticks: np.ndarray, at: np.ndarray, value: np.ndarray, lookback_s: int) -> tuple[np.ndarray, np.ndarray]:
    """At each tick whether a watch's condition holds, and the value it holds for. ``at`` is sorted."""
    i = np.searchsorted(at, ticks, side="right") - 1
    there = i >= 0
    i = np.maximum(i, 0)
    age = ticks - at[i] if len(at) else np.zeros(len(ticks), dtype=np.int64)
    if watch.field == SILENCE:
        seen = age / SECOND
        return there & _COMPARE[watch.op](seen, watch.threshold), seen
    seen = value[i] if len(at) else np.zeros(len(ticks))
    limit = lookback_s * SECOND
    if watch.stale_s is not None:
        stale = age >= watch.stale_s * SECOND
        seen = np.where(stale, 0.0, seen)
        age = np.where(stale, age - watch.stale_s * SECOND, age)
    with np.errstate(invalid="ignore"):
        return there & (age < limit) & _COMPARE[watch.op](seen, watch.threshold), seen


def since_when(held: np.ndarray, ticks: np.ndarray, before: int) -> np.ndarray:
    """For each tick at which a condition holds the first tick of its run; ``before`` is that of a run that still
    held at the tick before all of these, or ``_NEVER``."""
    opens = held.copy()
    opens[1:] &= ~held[:-1]
    if len(held) and held[0] and before != _NEVER:
        opens[0] = False
    at = np.maximum.accumulate(np.where(opens, np.arange(len(held)), -1)) if len(held) else np.empty(0, dtype=np.int64)
    return np.where(at >= 0, ticks[np.maximum(at, 0)], before) if len(held) else ticks


class AlertRules(StatefulProcessor):
    """Active alerts of one series (a drone), tick by tick.

    State per series: the last sample of each field, the samples that no tick has used yet (those within the
    watermark's delay), and since when each rule's condition holds. A series silent for ``forget_s`` is dropped.
    """

    def __init__(self, labels: Sequence[str], watches: Sequence[Watch], tie: str, every_s: int, step_s: int, lookback_s: int,
                 forget_s: int) -> None:
        self.labels, self.watches, self.tie = list(labels), list(watches), tie
        self.every, self.step, self.lookback_s, self.forget = every_s * SECOND, step_s * SECOND, lookback_s, forget_s * SECOND
        self.fields = sorted({w.field for w in watches if w.field != SILENCE})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "series", "field array<int>, at array<bigint>, us array<bigint>, tie array<bigint>, value array<double>, "
                      "since array<bigint>, tick bigint, seen bigint, timer bigint")

    def _load(self) -> tuple[Samples, np.ndarray, int, int, int]:
        state = self.state.get()
        if state is None:
            return Samples(*(np.empty(0, dtype=np.int64) for _ in range(4)), np.empty(0)), np.full(len(self.watches), _NEVER), _NEVER, _NEVER, _NEVER
        kinds = [np.int64] * 4 + [np.float64]
        samples = Samples(*(np.array(list(x), dtype=kind) for x, kind in zip(state[:5], kinds)))
        return samples, np.array(list(state[5]), dtype=np.int64), int(state[6]), int(state[7]), int(state[8])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        samples, since, tick, seen, timer = self._load()
        for batch in rows:
            us, tie = batch["us"].to_numpy(np.int64), batch[self.tie].to_numpy(np.int64)
            at = us // self.every * self.every + self.every
            for f, name in enumerate(self.fields):
                value = batch[name].to_numpy(dtype=np.float64, na_value=np.nan)
                there = batch[name].notna().to_numpy()
                samples = samples.and_(Samples(np.full(there.sum(), f), at[there], us[there], tie[there], value[there]))
            # Silence is counted from records themselves, not from the scrapes they are seen at.
            samples = samples.and_(Samples(np.full(len(us), len(self.fields)), us, us, tie, np.zeros(len(us))))
            first = int(us.min() + (-us.min()) % self.step)
            tick = first if tick == _NEVER else tick
            seen = max(seen, int(us.max()))
        yield from self._advance(key, samples, since, tick, seen, timer, timer_values.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        samples, since, tick, seen, timer = self._load()
        if tick != _NEVER:
            yield from self._advance(key, samples, since, tick, seen, _NEVER, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, samples: Samples, since: np.ndarray, tick: int, seen: int, timer: int, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Judge all ticks that the watermark has reached, keep what later ones need, and set the next timer."""
        samples = samples.newest()
        until = watermark_ms * 1000
        if seen + self.forget <= until:
            until = min(until, seen + self.forget)
        ticks = np.arange(tick, until + 1, self.step)
        out = []
        for w, watch in enumerate(self.watches):
            f = self.fields.index(watch.field) if watch.field != SILENCE else len(self.fields)
            mine = samples.where(samples.field == f)
            held, value = judged(watch, ticks, mine.at, mine.value, self.lookback_s)
            runs = since_when(held, ticks, int(since[w]))
            if len(ticks):
                since[w] = runs[-1] if held[-1] else _NEVER
            n = int(held.sum())
            if n:
                rows = {"alert": np.full(n, watch.alert, dtype=object), "tick": ticks[held], "since": runs[held], "value": value[held]}
                rows["state"] = np.where(rows["tick"] - rows["since"] >= watch.for_s * SECOND, "firing", "pending").astype(object)
                out.append(pd.DataFrame(rows))
        if len(ticks):
            tick = int(ticks[-1] + self.step)
            used = samples.at <= ticks[-1]  # of those a field's last one is still wanted
            last = np.ones(len(used), dtype=bool)
            last[:-1] = (samples.field[1:] != samples.field[:-1]) | ~used[1:]
            samples = samples.where(~used | last)
        self._keep(samples, since, tick, seen, timer, watermark_ms)
        if out:
            rows = pd.concat(out, ignore_index=True)
            for name, part in zip(self.labels, key):
                rows[name] = part
            yield rows[["alert", *self.labels, "tick", "since", "state", "value"]]

    def _keep(self, samples: Samples, since: np.ndarray, tick: int, seen: int, timer: int, watermark_ms: int) -> None:
        if seen + self.forget <= watermark_ms * 1000:
            self._set_timer(timer, _NEVER)
            self.state.clear()
            return
        wake = self._wake(samples, since, tick, seen)
        self._set_timer(timer, wake)
        self.state.update((*(x.tolist() for x in samples), since.tolist(), tick, seen, wake))

    def _wake(self, samples: Samples, since: np.ndarray, tick: int, seen: int) -> int:
        """Milliseconds of the next tick at which a rule's state may differ from what it is, by the samples so far."""
        if (since != _NEVER).any():
            return tick // 1000
        times = [seen + self.forget]
        for watch in self.watches:
            f = self.fields.index(watch.field) if watch.field != SILENCE else len(self.fields)
            at = samples.at[samples.field == f]
            if not len(at):
                continue
            waiting = at[at > tick - self.step]  # samples that no tick has used
            times += waiting[:1].tolist()
            later = watch.threshold if watch.field == SILENCE else watch.stale_s
            if later is not None and at[-1] + later * SECOND >= tick:
                times.append(int(at[-1] + later * SECOND))
        return max(tick, min(t + (-t) % self.step for t in times)) // 1000

    def _set_timer(self, old: int, new: int) -> None:
        if old == new:
            return
        if old != _NEVER:
            self.handle.deleteTimer(old - 1)
        if new != _NEVER:
            self.handle.registerTimer(new - 1)  # a timer goes off once the watermark is past it

    def close(self) -> None:
        pass


def alert_stream(
    telemetry: DataFrame, watches: Sequence[Watch], labels: Sequence[str] = ("drone_id", "swarm_id"), tie: str = "event_id",
    delay: str = WATERMARK, every_s: int = SCRAPE_S, step_s: int = STEP_S, lookback_s: int = LOOKBACK_S, forget_s: int = FORGET_S,
) -> DataFrame:
    """Active alerts ``(alert, labels, tick, since, state, value)`` of a telemetry stream, in append mode.

    All watches are judged in one step: one shuffle by ``labels``, one state per series. Rows are final: a tick
    comes out once, when the watermark has reached it, whether the drone has sent anything since or not. Start
    the query with :func:`fleetlens.streaming.jobs.use_rocksdb` settings. Rows without a time are left out.
    """
    fields = sorted({w.field for w in watches if w.field != SILENCE})
    narrow = telemetry.filter(F.col("us").isNotNull()).select(
        *dict.fromkeys([*labels, "us", tie, "ts"]), *[F.col(f).cast("double").alias(f) for f in fields])
    kinds = dict(narrow.dtypes)
    schema = f"alert string, {', '.join(f'{n} {kinds[n]}' for n in labels)}, tick bigint, since bigint, state string, value double"
    return narrow.withWatermark("ts", delay).groupBy(*labels).transformWithStateInPandas(
        AlertRules(labels, watches, tie, every_s, step_s, lookback_s, forget_s), schema, "Append", "EventTime")


class Connection(StatefulProcessor):
    """When a drone was last seen and whether it counts as connected: its own word, until it has been silent too long."""

    def __init__(self, tie: str, active_s: float) -> None:
        self.tie, self.active = tie, int(active_s * SECOND)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, tie bigint, swarm_id string, connected boolean, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        newest = None if state is None else (int(state[0]), int(state[1]), state[2], state[3])
        for batch in rows:
            batch = batch.sort_values(["us", self.tie], ignore_index=True)
            row = batch.iloc[-1]
            if newest is None or (int(row["us"]), int(row[self.tie])) > newest[:2]:
                newest = (int(row["us"]), int(row[self.tie]), None if pd.isna(row["swarm_id"]) else row["swarm_id"],
                          None if pd.isna(row["connected"]) else bool(row["connected"]))
        if state is not None and newest[:2] == (int(state[0]), int(state[1])):
            return  # all of them late: nothing new is known
        lost_ms = -(-(newest[0] + self.active) // 1000)
        if state is not None and state[4] != lost_ms:
            self.handle.deleteTimer(int(state[4]) - 1)
        self.handle.registerTimer(lost_ms - 1)
        self.last.update((*newest, lost_ms))
        yield self._row(key, newest, int(bool(newest[3])), newest[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        if state is not None and expiredTimerInfo.getExpiryTimeInMs() >= int(state[4]) - 1:
            yield self._row(key, state, 0, int(state[0]) + self.active)

    @staticmethod
    def _row(key, state, connected: int, at_us: int) -> pd.DataFrame:
        return pd.DataFrame({"drone_id": [key[0]], "swarm_id": [state[2] or "default"], "last_seen_us": [int(state[0])],
                             "connected": [connected], "at_us": [at_us]})

    def close(self) -> None:
        pass


def connection_stream(telemetry: DataFrame, active_s: float = ACTIVE_S, tie: str = "event_id", delay: str = WATERMARK) -> DataFrame:
    """Changes of drones' connection: ``(drone_id, swarm_id, last_seen_us, connected, at_us)``.

    One row per batch and drone heard of, and one when a drone has been silent for ``active_s``, by the watermark:
    it needs no later record of that drone. State is one row per drone.
    """
    narrow = telemetry.filter(F.col("us").isNotNull()).select("drone_id", "swarm_id", "us", tie, "connected", "ts")
    return narrow.withWatermark("ts", delay).groupBy("drone_id").transformWithStateInPandas(
        Connection(tie, active_s), "drone_id string, swarm_id string, last_seen_us bigint, connected int, at_us bigint", "Append", "EventTime")


def current_connections(spark: SparkSession, path: str) -> DataFrame:
    """Per drone the last change that :func:`connection_stream` wrote to ``path``."""
    changes = spark.read.parquet(path)
    # A loss follows the record it refers to; both name the same record.
    key = F.col("last_seen_us") * 2 + (F.col("at_us") > F.col("last_seen_us")).cast("bigint")
    return changes.groupBy("drone_id").agg(*[F.max_by(c, key).alias(c) for c in ("swarm_id", "last_seen_us", "connected")])
