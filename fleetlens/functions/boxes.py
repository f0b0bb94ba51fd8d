"""Box geometry as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from fleetlens.functions.columns import finite

BOX = ["x1", "y1", "x2", "y2"]


def proper() -> Column:
    """Whether a box has four finite corners, the first two not beyond the others. Records with fewer numbers give
    boxes that have not."""
    return reduce(and_, (finite(c) for c in BOX)) & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2"))


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; null where the union is empty."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = w * h
    return F.try_divide(inter.cast("double"), (area(a) + area(b) - inter).cast("double"))


def dead_zone(error: Column, center: float = 0.15, slow: float = 0.35) -> Column:
    """0 near the center, half strength in the slow zone, unchanged beyond it."""
    return F.when(F.abs(error) < center, 0.0).when(F.abs(error) < slow, error * 0.5).otherwise(error)
