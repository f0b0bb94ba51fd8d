"""As-of join of two streams: each left row with the latest right row of its key at or before it.

Both streams are stacked and keyed once. A left row waits until the watermark has reached its time, for then
every right row that could be its match is there, late ones included; a timer of event time lets it go even
if its key is silent from then on. Of the right rows a key keeps the last one that time has passed, and those
within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.windows import WATERMARK

#: Rows travel through the state as JSON, with times to the microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class AsOf(StatefulProcessor):
    """Waiting left rows and kept right rows of one key, each by time and tie."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        sides = ", ".join(f"{s}_us array<bigint>, {s}_tie array<bigint>, {s}_row array<string>" for s in ("left", "right"))
        self.rows = handle.getValueState("rows", f"{sides}, timer bigint")

    def _load(self) -> tuple[list[pd.DataFrame], int]:
        state = self.rows.get()
        if state is None:
            empty = pd.DataFrame({"us": np.empty(0, np.int64), "tie": np.empty(0, np.int64), "row": np.empty(0, object)})
            return [empty, empty], -1
        return [pd.DataFrame({"us": np.array(list(state[i]), np.int64), "tie": np.array(list(state[i + 1]), np.int64),
                              "row": np.array(list(state[i + 2]), object)}) for i in (0, 3)], int(state[6])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        sides, timer = self._load()
        for batch in rows:
            for i, mine in enumerate((batch["is_left"], ~batch["is_left"])):
                sides[i] = pd.concat([sides[i], batch.loc[mine, ["us", "tie", "row"]]], ignore_index=True)
        yield from self._advance(sides, timer, timer_values.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sides, timer = self._load()
        yield from self._advance(sides, -1, timerValues.getCurrentWatermarkInMs())

    def _advance(self, sides: list[pd.DataFrame], timer: int, watermark_ms: int) -> Iterator[pd.DataFrame]:
        until = watermark_ms * 1000
        left, right = (s.sort_values(["us", "tie"], ignore_index=True) for s in sides)
        ready = int(np.searchsorted(left["us"].to_numpy(), until, side="right"))
        if ready:
            place = np.searchsorted(right["us"].to_numpy(), left["us"].to_numpy()[:ready], side="right") - 1
            match = np.full(ready, None, dtype=object)
            match[place >= 0] = right["row"].to_numpy()[place[place >= 0]]
            yield pd.DataFrame({"left": left["row"].to_numpy()[:ready], "right": match})
            left = left.iloc[ready:]
        passed = int(np.searchsorted(right["us"].to_numpy(), until, side="right"))
        right = right.iloc[max(passed - 1, 0):]
        wake = -(-int(left["us"].iloc[0]) // 1000) if len(left) else -1
        if wake != timer:
            if timer != -1:
                self.handle.deleteTimer(timer - 1)
            if wake != -1:
                self.handle.registerTimer(wake - 1)  # a timer goes off once the watermark is past it
        self.rows.update((*(s[c].tolist() for s in (left, right) for c in ("us", "tie", "row")), wake))

    def close(self) -> None:
        pass


def asof_stream(
    left: DataFrame, right: DataFrame, keys: Sequence[str], right_fields: Sequence[str], name: str = "match",
    tie: str = "event_id", delay: str = WATERMARK,
) -> DataFrame:
    """Streaming form of :func:`fleetlens.operators.commands.asof_join`, in append mode.

    Both streams have ``keys``, ``us``, ``tie`` and an event time ``ts``. On equal times the right row counts as
    earlier. Every left row comes out once, with its match or null, when the watermark has reached it. Rows
    without a time are left out.
    """
    def packed(df: DataFrame, is_left: bool, columns: Sequence[str]) -> DataFrame:
        return df.filter(F.col("us").isNotNull()).select(
            *keys, "ts", "us", F.col(tie).cast("bigint").alias("tie"), F.lit(is_left).alias("is_left"),
            F.to_json(F.struct(*columns), _JSON).alias("row"))

    kinds = {"left": left.select(F.struct(*left.columns)).schema[0].dataType,
             "right": right.select(F.struct(*right_fields)).schema[0].dataType}
    both = packed(left, True, left.columns).unionByName(packed(right, False, right_fields))
    matched = both.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(
        AsOf(), "left string, right string", "Append", "EventTime")
    rows = matched.select(F.from_json("left", kinds["left"], _JSON).alias("left"), F.from_json("right", kinds["right"], _JSON).alias(name))
    return rows.select("left.*", name)


def command_latency_stream(commands: DataFrame, telemetry: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Milliseconds from a drone's latest telemetry to each command, as both streams come in."""
    matched = asof_stream(commands, telemetry, ["drone_id"], ["us", "event_id"], "telemetry", delay=delay)
    return matched.withColumn("latency_ms", (F.col("us") - F.col("telemetry.us")) / F.lit(1000.0))
