"""Target following on a stream of frames: one state per drone, and a timer for targets that do not come back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fleetlens.functions.boxes import BOX, area
from fleetlens.functions.columns import finite
from fleetlens.operators.detections import LOST_AFTER_S, chosen_targets, with_errors

_NEVER = -(1 << 62)
_PICKED = ["det_id", "track_id", "conf", *BOX]


def frame_picks(frames: DataFrame, target_class: str, locked_id: int | None, boxes: str = "boxes") -> DataFrame:
    """Per frame whether a target is there, its largest box, and that of the locked track; all within the frame's row.

    ``boxes`` is an array of structs with ``det_idx, det_id, track_id, class_name, conf`` and corners.
    """
    def best(where) -> Column:
        def usable(b: Column) -> Column:
            good = where(b) & (b["x1"] <= b["x2"]) & (b["y1"] <= b["y2"])
            for c in BOX:
                good = good & finite(b[c])
            return F.coalesce(good, F.lit(False))

        ranked = F.transform(F.filter(boxes, usable), lambda b: F.struct(area(b).cast("double").alias("size"), (-b["det_idx"]).alias("i"), b.alias("b")))
        return F.array_max(ranked)["b"]

    def is_target(b: Column) -> Column:
        return b["class_name"] == target_class

    def is_locked(b: Column) -> Column:
        return is_target(b) & (b["track_id"] == F.lit(locked_id)) if locked_id else F.lit(False)

    both = frames.withColumns({"_largest": best(is_target), "_locked": best(is_locked), "found": F.coalesce(F.exists(boxes, is_target), F.lit(False)),
                               "locked_found": F.coalesce(F.exists(boxes, is_locked), F.lit(False))})
    return both.select("drone_id", "frame_no", "us", "ts", "found", "locked_found", *[
        F.col(f"_{side}.{c}").alias(f"{side}_{c}") for side in ("largest", "locked") for c in _PICKED])


class Following(StatefulProcessor):
    """When a drone last saw a target, whether it still holds one, and how large it was when it was taken up.

    Frames are taken in the order of time and number within a batch. A frame that is older than the state comes
    out as ``late`` and changes nothing. If no frame comes while a target is lost, a timer of event time ends it.
    """

    def __init__(self, columns: list[str], lost_after_us: int) -> None:
        self.columns, self.limit = columns, lost_after_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "us bigint, frame_no bigint, seen bigint, reference bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True).sort_values(["us", "frame_no"], ignore_index=True)
        state = self.state.get()
        last_us, last_frame, seen, reference, timer = (int(x) for x in state) if state is not None else (_NEVER, _NEVER, _NEVER, -1, -1)
        us, number = frames["us"].to_numpy(np.int64), frames["frame_no"].to_numpy(np.int64)
        late = (us < last_us) | ((us == last_us) & (number <= last_frame))
        old, new = frames[late], frames[~late]
        if len(new):
            us, found = us[~late], new["found"].to_numpy(bool)
            before = np.append(last_us, us[:-1])  # the frame before each, and the last one with a target before it
            seen_with = np.maximum(np.maximum.accumulate(np.where(found, us, _NEVER)), seen)
            seen_before = np.append(seen, seen_with[:-1])
            held = (seen_before != _NEVER) & (before != _NEVER) & (before - seen_before < self.limit)
            locked = held & new["locked_found"].to_numpy(bool)
            sizes = np.where(locked, _pixels(new, "locked"), _pixels(new, "largest"))
            fresh = found & ~held & (sizes >= 0)
            place = np.maximum.accumulate(np.where(fresh, np.arange(len(us)), -1))
            references = np.where(place >= 0, sizes[np.maximum(place, 0)], reference)
            seen, reference = int(seen_with[-1]), int(references[-1])
            ends = -(-(seen + self.limit) // 1000) if seen != _NEVER else -1
            if ends != timer:
                if timer != -1:
                    self.handle.deleteTimer(timer - 1)
                if ends != -1:
                    self.handle.registerTimer(ends - 1)
            self.state.update((int(us[-1]), int(new["frame_no"].iloc[-1]), seen, reference, ends))
            yield self._rows(new, held, seen_before, references, False)
        if len(old):
            none = np.full(len(old), _NEVER)
            yield self._rows(old, np.zeros(len(old), bool), none, np.full(len(old), -1), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        if state is None or expiredTimerInfo.getExpiryTimeInMs() != int(state[4]) - 1:
            return
        last_us, last_frame, seen, reference, _ = (int(x) for x in state)
        self.state.update((last_us, last_frame, seen, reference, -1))
        if last_us - seen < self.limit:  # else a frame has told so already
            ended = pd.DataFrame({c: [None] for c in self.columns}, dtype=object)
            ended["drone_id"], ended["us"], ended["found"], ended["locked_found"] = key[0], seen + self.limit, False, False
            yield self._rows(ended, np.zeros(1, bool), np.array([seen]), np.array([-1]), False)

    def _rows(self, frames: pd.DataFrame, held: np.ndarray, seen: np.ndarray, reference: np.ndarray, late: bool) -> pd.DataFrame:
        out = frames[self.columns].copy()
        out["_held"] = held
        out["_last_us"] = pd.array(seen, dtype="Int64")
        out.loc[seen == _NEVER, "_last_us"] = pd.NA
        out["_reference"] = pd.array(reference, dtype="Int64")
        out.loc[reference < 0, "_reference"] = pd.NA
        out["late"] = late
        return out

    def close(self) -> None:
        pass


def _pixels(frames: pd.DataFrame, side: str) -> np.ndarray:
    """Areas of the boxes cut to whole pixels, as the batch form has them; -1 where there is no box."""
    x1, y1, x2, y2 = (np.trunc(frames[f"{side}_{c}"].to_numpy(dtype=float, na_value=np.nan)) for c in BOX)
    size = (x2 - x1) * (y2 - y1)
    return np.where(np.isnan(size), -1, np.nan_to_num(size)).astype(np.int64)


def follow_stream(
    frames: DataFrame, target_class: str = "car", locked_id: int | None = None, width: int = 200, height: int = 160,
    lost_after_s: float = LOST_AFTER_S, delay: str = "1 second",
) -> DataFrame:
    """Streaming form of :func:`fleetlens.operators.detections.follow`, a row per frame as soon as it comes in.

    ``frames`` has ``drone_id, frame_no, us, ts`` and ``boxes``, an array. Where no frame comes for ``lost_after_s``
    after a target was seen, a row without a frame number says ``searching``, when the watermark has passed
    that time. Late frames have the state ``late``.
    """
    limit = int(lost_after_s * 1e6)
    picks = frame_picks(frames.filter(F.col("us").isNotNull() & F.col("frame_no").isNotNull()), target_class, locked_id)
    schema = StructType([*picks.drop("ts").schema.fields, *StructType.fromDDL("_held boolean, _last_us bigint, _reference bigint, late boolean").fields])
    stated = picks.withWatermark("ts", delay).groupBy("drone_id").transformWithStateInPandas(
        Following(picks.drop("ts").columns, limit), schema, "Append", "EventTime")
    targets = chosen_targets(stated, F.lit(limit), ["_reference", "late"])
    return with_errors(targets.withColumn("state", F.when(F.col("late"), "late").otherwise(F.col("state"))), width, height)
