"""Greedy overlap suppression per frame, by the size of the frame.

The rule takes boxes best first and keeps one unless it overlaps a kept one. A frame of a few boxes is folded
in one expression. In a large frame whose boxes are spread out, pairs that overlap too much come from a spatial
join, and rounds over these pairs decide boxes wherever the frame's rows are: a box with no better undecided
partner stays, and its partners go. A frame whose boxes crowd has few that stay, and is walked box by box.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.boxes import BOX, iou, proper
from fleetlens.functions.columns import exponent, finite
from fleetlens.operators.grouped import Group, map_groups
from fleetlens.session import written

IOU_LIMIT = 0.5
#: Boxes of a frame that are folded at once.
FOLD = 64
#: Boxes that share a cell with one box of a frame, on average, beyond which it is crowded.
CROWDED = 256
#: Rounds over the pairs; a chain of pairs that is longer is walked box by box from there.
ROUNDS = 6
#: Below this limit boxes of very different sizes matter to each other, and cells are no help.
LEAST_LIMIT = 0.1


def nms(dets: DataFrame, frame: list[str], limit: float = IOU_LIMIT, extra: list[str] | None = None, fold: int = FOLD) -> DataFrame:
    """Greedy suppression per frame, across classes: keep a box unless it overlaps a better kept one.

    Better means higher ``conf``, then lower ``det_idx``. An undefined overlap (two empty boxes)
    suppresses as well. ``limit`` is below 1: exact copies collapse to the best of them in a partial aggregation before frames
    come together. Malformed boxes (see :func:`fleetlens.operators.detections.malformed`) neither stay nor suppress
    others; keys and ``det_idx`` must be non-null. Frames are counted first; where some have more than ``fold``
    boxes, these are written out and decided in rounds, when the query is built.
    """
    rest = ["det_id", *(extra or [])]
    best = F.min(F.struct((-F.col("conf")).alias("neg"), "det_idx", *rest)).alias("best")
    distinct = dets.filter(proper() & finite("conf")).groupBy(*frame, *BOX).agg(best).select(*frame, "best.*", *BOX)
    result = [*frame, *rest, "det_idx", *BOX, "neg"]

    large = dets.filter(proper()).groupBy(*frame).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold).drop("_n")
    large = written(large, "large-frames")
    if large.isEmpty():
        kept = _folded(distinct, frame, limit, result)
    else:
        small = _folded(distinct.join(large, frame, "left_anti"), frame, limit, result)
        kept = small.unionByName(_spread_out(distinct.join(large, frame, "left_semi"), frame, limit, result))
    return kept.select(*frame, *rest, "det_idx", *BOX, (-F.col("neg")).alias("conf"))


def _folded(boxes: DataFrame, frame: list[str], limit: float, result: list[str]) -> DataFrame:
    """Every frame as one array, best first, folded into the boxes that stay."""
    own = [c for c in result if c not in frame]
    ordered = F.array_sort(F.collect_list(F.struct("neg", "det_idx", *[c for c in own if c not in ("neg", "det_idx")])))
    frames = boxes.groupBy(*frame).agg(ordered.alias("_boxes"))

    def step(kept: Column, box: Column) -> Column:
        hit = F.exists(kept, lambda k: F.coalesce(iou(k, box) > limit, F.lit(True)))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(box)))

    kept = F.aggregate("_boxes", F.slice("_boxes", 1, 1), step)  # the first box stays; it hits itself
    return frames.select(*frame, F.inline(kept)).select(result)


def _spread_out(boxes: DataFrame, frame: list[str], limit: float, result: list[str]) -> DataFrame:
    """Frames of many boxes."""
    if limit < LEAST_LIMIT:
        return _walked(boxes, frame, limit, result)
    numbered = written(boxes.withColumn("_id", F.monotonically_increasing_id()), "boxes")
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    empty = (width == 0) | (height == 0)
    # Empty boxes overlap each other in no defined way, so one of them stays; they touch no others.
    order = F.struct("neg", "det_idx", "_id")
    one = numbered.filter(empty).groupBy(*frame).agg(F.min(F.struct(order.alias("o"), F.struct(*result).alias("row"))).alias("b"))
    alone = one.select("b.row.*").select(result)

    sized = numbered.filter(~empty).withColumns({"_w": exponent(width), "_h": exponent(height)})
    cell = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col(level))).cast("bigint") for c, level in (("x1", "_w"), ("y1", "_h"))]
    per_cell = sized.groupBy(*frame, "_w", "_h", cell[0].alias("_cx"), cell[1].alias("_cy")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowded = written(per_cell.groupBy(*frame).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).filter(
        F.col("pairs") > CROWDED * F.col("n")).select(*frame), "crowded-frames")
    walked = _walked(sized.join(crowded, frame, "left_semi"), frame, limit, result)
    kept = _by_rounds(sized.join(crowded, frame, "left_anti"), frame, limit, result)
    return alone.unionByName(walked).unionByName(kept)


def _pairs(sized: DataFrame, frame: list[str], limit: float) -> DataFrame:
    """``(better, worse)``: ids of boxes of a frame that overlap by more than ``limit``.

    Such boxes differ in width and in height by less than a factor of ``1 / limit``, and in place by less than
    ``1 - limit`` of the larger. Each box stands in a cell of its own size and of the next larger ones, and asks the
    cells around; a pair meets once, at the larger size of the two.
    """
    levels, around = math.ceil(math.log2(1 / limit)), math.ceil(2 * (1 - limit))
    steps = F.array(*[F.lit(i) for i in range(levels + 1)])
    placed = sized.select(*frame, "_id", "neg", "det_idx", F.struct(*BOX).alias("box"), "_w", "_h", F.explode(steps).alias("_up")).select(
        "*", (F.col("_w") + F.col("_up")).alias("lw"), F.explode(steps).alias("_out")).withColumn("lh", F.col("_h") + F.col("_out"))
    placed = placed.withColumns({
        "cx": F.floor(F.col("box.x1") / F.pow(F.lit(2.0), F.col("lw"))).cast("bigint"),
        "cy": F.floor(F.col("box.y1") / F.pow(F.lit(2.0), F.col("lh"))).cast("bigint")}).drop("_up", "_out")
    near = F.array(*[F.lit(i) for i in range(-around, around + 1)])
    asking = placed.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumns(
        {"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")}).drop("_dx", "_dy")
    keys = [*frame, "lw", "lh", "cx", "cy"]
    a, b = (df.select(*keys, F.struct("neg", "det_idx", "_id", "box", "_w", "_h").alias(side)) for df, side in ((asking, "a"), (placed, "b")))
    better = F.struct("a.neg", "a.det_idx", "a._id") < F.struct("b.neg", "b.det_idx", "b._id")
    at_larger = (F.col("lw") == F.greatest("a._w", "b._w")) & (F.col("lh") == F.greatest("a._h", "b._h"))
    return a.join(b, keys).filter(better & at_larger & (iou(F.col("a.box"), F.col("b.box")) > limit)).select(
        F.col("a._id").alias("better"), F.col("b._id").alias("worse"))


def _by_rounds(sized: DataFrame, frame: list[str], limit: float, result: list[str]) -> DataFrame:
    """Boxes with no better undecided partner stay, and their partners go, until no pair is undecided."""
    pairs = written(_pairs(sized, frame, limit), "overlaps")
    gone: list[DataFrame] = []
    rounds = 0
    while rounds < ROUNDS and not pairs.isEmpty():
        # Who is better in some pair and worse in none stays.
        stay = pairs.select(F.col("better").alias("_id")).distinct().join(pairs.select(F.col("worse").alias("_id")).distinct(), "_id", "left_anti")
        lose = written(pairs.join(stay.withColumnRenamed("_id", "better"), "better", "left_semi").select(F.col("worse").alias("_id")).distinct(), "lost")
        gone.append(lose)
        for end in ("better", "worse"):  # a pair with a box that is gone, or whose better box stays, says nothing more
            pairs = pairs.join(lose.withColumnRenamed("_id", end), end, "left_anti")
        pairs = written(pairs, "overlaps")
        rounds += 1
    if not gone:
        return sized.select(result)
    lost = reduce(DataFrame.unionByName, gone).distinct()
    left = sized.join(lost, "_id", "left_anti")
    if pairs.isEmpty():
        return left.select(result)
    # Long chains: boxes that still have a partner are walked; all others are decided.
    ends = pairs.select(F.col("better").alias("_id")).unionByName(pairs.select(F.col("worse").alias("_id"))).distinct()
    return left.join(ends, "_id", "left_anti").select(result).unionByName(_walked(left.join(ends, "_id", "left_semi"), frame, limit, result))


def _walked(boxes: DataFrame, frame: list[str], limit: float, result: list[str]) -> DataFrame:
    """Box by box: every box that stays is compared with all that are left of its frame. A frame is the group in
    memory, at some tens of bytes a box."""
    slim = boxes.select(result)

    def keep(group: Group) -> Group:
        rows = np.lexsort((group["det_idx"], group["neg"]))
        rows = rows[_greedy(corners(group)[:, rows], limit)]
        return {name: values[rows] for name, values in group.items()}

    return map_groups(slim, frame, ["neg", "det_idx"], keep, ddl(slim))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def corners(group: Group) -> np.ndarray:
    return np.stack([group[c].astype(np.float64) for c in BOX])


def overlap(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Intersection over union of ``boxes`` with one box; NaN where the union is empty."""
    x1, y1, x2, y2 = boxes
    inter = np.maximum(np.minimum(x2, box[2]) - np.maximum(x1, box[0]), 0) * np.maximum(
        np.minimum(y2, box[3]) - np.maximum(y1, box[1]), 0)
    union = (x2 - x1) * (y2 - y1) + (box[2] - box[0]) * (box[3] - box[1]) - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        return inter / union


def _greedy(boxes: np.ndarray, limit: float) -> np.ndarray:
    """Columns of ``boxes``, best first, that stay."""
    left, kept = np.arange(boxes.shape[1]), []
    while len(left):
        kept.append(left[0])
        left = left[1:]
        left = left[overlap(boxes[:, left], boxes[:, kept[-1]]) <= limit]
    return np.array(kept, dtype=np.int64)
