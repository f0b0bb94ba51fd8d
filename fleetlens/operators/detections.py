"""Post-processing of object detections: tiling, overlap suppression, target following."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.boxes import BOX, area, dead_zone, proper
from fleetlens.functions.columns import finite, sortable
from fleetlens.operators.grouped import Group, map_groups
from fleetlens.operators.ordered import DEFAULT_SLICE_US, with_history
from fleetlens.operators.suppression import IOU_LIMIT, corners, ddl, nms, overlap
from fleetlens.session import written

__all__ = ["BOX", "nms"]

CONFIDENCE = 0.25
PUBLISH_EVERY = 3
LOST_AFTER_S = 2.0


def confident(df: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    return df.filter(F.col("conf") >= threshold)


def every_nth(df: DataFrame, number: str = "frame_no", n: int = PUBLISH_EVERY) -> DataFrame:
    return df.filter(F.pmod(number, F.lit(n)) == 0)


def of_class(df: DataFrame, class_name: str) -> DataFrame:
    """Detections of one class, for rows that carry ``class_name``."""
    return df.filter(F.col("class_name") == class_name)


def malformed(dets: DataFrame) -> DataFrame:
    """Boxes that cannot be placed or ranked: a corner or the confidence is absent, NaN or infinite, or corners are
    the wrong way round."""
    return dets.filter(~(proper() & finite("conf")))


def tiles(frames: DataFrame) -> DataFrame:
    """Tile grid of every frame: ``tile_rows`` x ``tile_cols``, grown by ``overlap`` and clamped.

    Takes ``width, height, tile_rows, tile_cols, overlap`` per frame.
    """
    th, tw = F.expr("height div tile_rows"), F.expr("width div tile_cols")
    oh, ow = F.floor(th * F.col("overlap")).cast("bigint"), F.floor(tw * F.col("overlap")).cast("bigint")
    row, col = F.col("tile_row"), F.col("tile_col")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        frames.withColumn("tile_row", F.explode(F.sequence(zero, F.col("tile_rows") - one)))
        .withColumn("tile_col", F.explode(F.sequence(zero, F.col("tile_cols") - one)))
        .withColumns({
            "tile_y1": F.greatest(zero, row * th - oh),
            "tile_y2": F.least(F.col("height"), (row + 1) * th + oh),
            "tile_x1": F.greatest(zero, col * tw - ow),
            "tile_x2": F.least(F.col("width"), (col + 1) * tw + ow),
        })
    )


def to_frame(local: DataFrame, tile_table: DataFrame, keys: list[str]) -> DataFrame:
    """Move boxes from tile to frame coordinates; tiles of one frame end up in one table."""
    moved = local.join(tile_table.select(*keys, "tile_x1", "tile_y1"), keys)
    return moved.withColumns({
        "x1": F.col("x1") + F.col("tile_x1"), "x2": F.col("x2") + F.col("tile_x1"),
        "y1": F.col("y1") + F.col("tile_y1"), "y2": F.col("y2") + F.col("tile_y1"),
    }).drop("tile_x1", "tile_y1")


def overlapping(dets: DataFrame, frame: list[str], limit: float = IOU_LIMIT) -> DataFrame:
    """Per detection: how many other boxes of its frame overlap it by more than ``limit``; nothing is paired up.
    Boxes without four finite corners are left out."""
    slim = dets.filter(proper()).select(*frame, "det_id", *BOX)

    def count(group: Group) -> Group:
        boxes = corners(group)
        with np.errstate(invalid="ignore"):
            found = [int((overlap(boxes, box) > limit).sum() - (overlap(box[:, None], box)[0] > limit)) for box in boxes.T]
        return {**{name: group[name] for name in (*frame, "det_id")}, "n_overlapping": np.array(found, dtype=np.int64)}

    return map_groups(slim, frame, ["det_id"], count, f"{ddl(slim.select(*frame, 'det_id'))}, n_overlapping bigint")


def formatted(df: DataFrame) -> DataFrame:
    """Result rows: rounded confidence and box, latency and frame rate. Needs ``class_name``."""
    rate = F.when(F.col("latency_s") > 0, F.lit(1.0) / F.col("latency_s")).otherwise(0.0)
    return df.withColumns({
        "confidence": F.round("conf", 3),
        "bbox": F.array(*[F.round(F.col(c).cast("double"), 1) for c in BOX]),
        "fps": F.round(rate, 1),
        "latency_s": F.round("latency_s", 4),
    })


def largest(dets: DataFrame, keys: list[str]) -> DataFrame:
    """The box with the largest area per frame, the first one on ties. Malformed boxes do not count."""
    return dets.groupBy(*keys).agg(*_pick(F.lit(True), ""))


def _pick(where: Column, prefix: str) -> list[Column]:
    # One decimal orders by area, to the last bit, and then by index; a struct would force a sort.
    ranked = sortable(area(F.struct(*BOX))).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    key = F.when(where & proper(), ranked - F.col("det_idx"))
    return [F.max_by(c, key).alias(f"{prefix}{c}") for c in ["det_id", "track_id", "conf", *BOX]]


def geometry() -> dict[str, Column]:
    """Centre and area of a target's box, whose corners are cut to whole pixels first."""
    x1, y1, x2, y2 = (F.col(c).cast("bigint") for c in BOX)
    return {"cx": F.floor((x1 + x2) / 2), "cy": F.floor((y1 + y2) / 2), "area": (x2 - x1) * (y2 - y1)}


def frame_errors(width: int, height: int) -> tuple[Column, Column]:
    """How far ``cx, cy`` are from the middle of the frame, as a share of half its size, with the dead zone."""
    return (dead_zone((F.col("cx") - width // 2) / F.lit(width / 2)),
            dead_zone((F.col("cy") - height // 2) / F.lit(height / 2)))


def follow(
    tracks: DataFrame, target_class: str = "car", locked_id: int | None = None, width: int = 200, height: int = 160,
    lost_after_s: float = LOST_AFTER_S, slice_us: int = DEFAULT_SLICE_US,
) -> DataFrame:
    """Follow state, chosen target and frame errors per drone and frame.

    ``tracks`` has all boxes with ``class_name``. A frame with target boxes is followed: the
    locked track if a target was held before and the track is there, else the largest box.
    Without target boxes the state is ``lost`` for ``lost_after_s``, then ``searching``, which
    drops the target and its reference area.

    One aggregation reduces boxes to frames, which are written out, as two passes over their
    history follow; the history is cut into time slices.
    """
    is_target = F.col("class_name") == target_class
    locked = is_target & (F.col("track_id") == F.lit(locked_id)) if locked_id else F.lit(False)
    frames = tracks.groupBy("drone_id", "frame_no", "us").agg(
        F.max(is_target).alias("found"),
        *_pick(is_target, "largest_"),
        F.max(locked).alias("locked_found"),
        *_pick(locked, "locked_"),
    ).withColumn("_seen_us", F.when(F.col("found"), F.col("us")))
    frames = written(frames, "frames")

    history = with_history(
        frames, ["drone_id"], "us", "frame_no",
        previous={"_prev": ["us"]}, before={"_last_us": "_seen_us"}, width=slice_us,
    )
    limit = F.lit(int(lost_after_s * 1e6))
    held = F.coalesce(F.col("_prev.us") - F.col("_last_us") < limit, F.lit(False))
    targets = chosen_targets(history.withColumn("_held", held), limit)
    fresh = F.when(F.col("found") & ~F.col("_held"), F.col("area"))
    referred = with_history(
        targets.withColumn("_fresh", fresh), ["drone_id"], "us", "frame_no",
        carried={"_reference": "_fresh"}, width=slice_us,
    )
    return with_errors(referred, width, height)


def chosen_targets(frames: DataFrame, limit: Column, also: Sequence[str] = ()) -> DataFrame:
    """State and target of frames with ``_held`` and ``_last_us``, the time of the last frame with a target before;
    ``also`` names further columns to keep."""
    chosen = {
        c: F.when(F.col("_held") & F.col("locked_found"), F.col(f"locked_{c}")).otherwise(F.col(f"largest_{c}"))
        for c in ["det_id", "track_id", "conf", *BOX]
    }
    state = (
        F.when(F.col("found"), "following")
        .when(F.col("us") - F.col("_last_us") < limit, "lost")
        .otherwise("searching")
    )
    return frames.select(
        "drone_id", "frame_no", "us", state.alias("state"), "_held", "found", *also, *[v.alias(k) for k, v in chosen.items()]
    ).withColumns({c: F.when(F.col("found"), v) for c, v in geometry().items()})


def with_errors(targets: DataFrame, width: int, height: int) -> DataFrame:
    """Frame errors of targets with ``_reference``, the area that the target had when it was taken up."""
    error_x, error_y = frame_errors(width, height)
    return targets.withColumn("reference_area", F.when(F.col("found"), F.col("_reference"))).select(
        "drone_id", "frame_no", "us", "state", "det_id", "track_id", "conf", *BOX, "cx", "cy", "area", "reference_area",
        error_x.alias("error_x"), error_y.alias("error_y"),
        F.try_divide((F.col("reference_area") - F.col("area")).cast("double"), F.col("reference_area").cast("double"))
        .alias("error_distance"),
    )
