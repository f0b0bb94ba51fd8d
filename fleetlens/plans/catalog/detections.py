"""Detections and target following."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import fixtures
from fleetlens.operators import detections as D, lookups
from fleetlens.plans.catalog.base import DETECTIONS, query
from fleetlens.plans.catalog.fleet import _MODES, CLASSES, FRAMES

FRAME = ["drone_id", "frame_no"]


@query("confident_detections", f"WITH {DETECTIONS} SELECT det_id, conf FROM det WHERE conf >= 25e-2")
def confident_detections(spark, sf_dir):
    return D.confident(fixtures.detections(spark, sf_dir)).select("det_id", "conf")


@query("published_frames", f"WITH {FRAMES} SELECT frame_no, drone_id FROM frame WHERE frame_no % 3 = 0")
def published_frames(spark, sf_dir):
    return D.every_nth(fixtures.frames(spark, sf_dir)).select("frame_no", "drone_id")


@query("target_class_tracks", f"WITH {DETECTIONS} SELECT det_id, drone_id FROM det JOIN {CLASSES} USING (cls_id) WHERE class_name = 'car'")
def target_class_tracks(spark, sf_dir):
    named = lookups.with_class_name(fixtures.detections(spark, sf_dir), lookups.class_table(spark))
    return D.of_class(named, "car").select("det_id", "drone_id")


TILES = FRAMES + f""",
configured AS (SELECT frame_no, drone_id, 200 AS width, 160 AS height, tile_rows, tile_cols, overlap
  FROM frame JOIN {_MODES} ON config_mode = speed_mode),
tile AS (
  SELECT *, height // tile_rows AS th, width // tile_cols AS tw FROM configured,
    unnest(range(tile_rows)) AS r(tile_row), unnest(range(tile_cols)) AS c(tile_col)),
placed AS (
  SELECT *, greatest(0, tile_row * th - floor(th * overlap)::BIGINT)::BIGINT AS tile_y1,
    least(height, (tile_row + 1) * th + floor(th * overlap)::BIGINT)::BIGINT AS tile_y2,
    greatest(0, tile_col * tw - floor(tw * overlap)::BIGINT)::BIGINT AS tile_x1,
    least(width, (tile_col + 1) * tw + floor(tw * overlap)::BIGINT)::BIGINT AS tile_x2 FROM tile)"""


def tile_table(spark, sf_dir):
    f = lookups.with_speed_config(fixtures.frames(spark, sf_dir), lookups.speed_table(spark))
    size = {"width": F.lit(200).cast("bigint"), "height": F.lit(160).cast("bigint")}
    return D.tiles(f.withColumns(size))


@query("tile_grid", f"""WITH {TILES}
SELECT frame_no, tile_row::BIGINT AS tile_row, tile_col::BIGINT AS tile_col, tile_x1, tile_y1, tile_x2, tile_y2 FROM placed""")
def tile_grid(spark, sf_dir):
    return tile_table(spark, sf_dir).select(
        "frame_no", "tile_row", "tile_col", "tile_x1", "tile_y1", "tile_x2", "tile_y2"
    )


@query("tile_boxes_in_frame", f"""WITH {TILES},
found AS (SELECT d.*, (det_idx // tile_cols) % tile_rows AS tile_row, det_idx % tile_cols AS tile_col
  FROM det d JOIN configured c USING (frame_no))
SELECT f.det_id, f.x1 + p.tile_x1 AS x1, f.y1 + p.tile_y1 AS y1, f.x2 + p.tile_x1 AS x2, f.y2 + p.tile_y1 AS y2
FROM found f JOIN placed p USING (frame_no, tile_row, tile_col)""")
def tile_boxes_in_frame(spark, sf_dir):
    table = tile_table(spark, sf_dir)
    sizes = lookups.with_speed_config(fixtures.frames(spark, sf_dir), lookups.speed_table(spark))
    local = fixtures.detections(spark, sf_dir).join(sizes.select("frame_no", "tile_rows", "tile_cols"), "frame_no").withColumns({
        "tile_row": F.expr("(det_idx div tile_cols) % tile_rows"), "tile_col": F.expr("det_idx % tile_cols"),
    })
    moved = D.to_frame(local, table, ["frame_no", "tile_row", "tile_col"])
    return moved.select("det_id", *D.BOX)


@query("overlapping_boxes", f"""WITH {DETECTIONS},
pair AS (
  SELECT a.det_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas
  FROM det a JOIN det b ON a.frame_no = b.frame_no AND a.det_id <> b.det_id)
SELECT det_id, count(*) FILTER (3 * inter > areas) AS n_overlapping FROM pair GROUP BY det_id""")
def overlapping_boxes(spark, sf_dir):
    return D.overlapping(fixtures.detections(spark, sf_dir), FRAME).select("det_id", "n_overlapping")


def suppressed_sql(where: str = "true") -> str:
    """Boxes one by one, best first; each is kept unless it overlaps one that was kept."""
    return f"""WITH RECURSIVE {DETECTIONS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY conf DESC, det_idx) AS rn FROM det WHERE {where}),
walk(frame_no, rn, kept) AS (
  SELECT frame_no, rn, [{{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.frame_no, r.rn, CASE WHEN len(list_filter(w.kept, lambda k:
      3 * (greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1)))
      > (k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1))) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'id': r.det_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
  FROM walk w JOIN ranked r ON r.frame_no = w.frame_no AND r.rn = w.rn + 1),
done AS (SELECT frame_no, arg_max(kept, rn) AS kept FROM walk GROUP BY frame_no)
SELECT unnest(kept).id AS det_id, frame_no FROM done"""


@query("suppressed_boxes", suppressed_sql())
def suppressed_boxes(spark, sf_dir):
    return D.nms(fixtures.detections(spark, sf_dir), FRAME).select("det_id", "frame_no")


def with_malformed(d):
    """Some boxes lose a corner, some have one that is no number, and those that lose one are the surest of all."""
    eid = F.col("det_id")
    return d.withColumns({
        "x2": F.when(eid % 13 != 0, F.col("x2").cast("double")),
        "y1": F.when(eid % 17 == 0, F.lit(float("nan"))).when(eid % 19 == 0, F.lit(float("-inf"))).otherwise(F.col("y1").cast("double")),
        "conf": F.when(eid % 13 == 0, 0.9999).when(eid % 23 != 0, F.col("conf")),
    })


WELL_FORMED = "det_id % 13 <> 0 AND det_id % 17 <> 0 AND det_id % 19 <> 0 AND det_id % 23 <> 0"


@query("suppressed_boxes_malformed", suppressed_sql(WELL_FORMED))
def suppressed_boxes_malformed(spark, sf_dir):
    return D.nms(with_malformed(fixtures.detections(spark, sf_dir)), FRAME).select("det_id", "frame_no")


@query("malformed_boxes", f"WITH {DETECTIONS} SELECT det_id, frame_no FROM det WHERE NOT ({WELL_FORMED})".replace(
    "det_id % 23 <> 0", "(det_id % 23 <> 0 OR det_id % 13 = 0)"))
def malformed_boxes(spark, sf_dir):
    return D.malformed(with_malformed(fixtures.detections(spark, sf_dir))).select("det_id", "frame_no")


@query("formatted_detections", f"""WITH {FRAMES}
SELECT det_id, coalesce(class_name, d.cls_id::VARCHAR) AS class_name, R3(conf) AS confidence,
  concat_ws(',', x1::DOUBLE, y1::DOUBLE, x2::DOUBLE, y2::DOUBLE) AS bbox, R1(1e0 / latency_s) AS fps, R4(latency_s) AS latency_s
FROM (SELECT * REPLACE (cls_id + det_idx // 7 * 5 AS cls_id) FROM det) d JOIN frame f USING (frame_no, drone_id)
LEFT JOIN {CLASSES} ON classes.cls_id = d.cls_id""")
def formatted_detections(spark, sf_dir):
    d = fixtures.detections(spark, sf_dir).withColumn("cls_id", F.col("cls_id") + F.expr("det_idx div 7") * 5)
    named = lookups.with_class_name(d, lookups.class_table(spark), unknown=None)
    timed = named.join(fixtures.frames(spark, sf_dir).select(*FRAME, "latency_s"), FRAME)
    return D.formatted(timed).select(
        "det_id", "class_name", "confidence", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"),
        "fps", "latency_s",
    )


# Boxes with fractions of pixels, as decoded ones have; quarters and eighths, so that areas are exact.
FRACTIONAL = DETECTIONS.replace("det AS (", "whole_det AS (") + """,
fdet AS (SELECT * REPLACE (x1 + (det_id % 4) * 25e-2 AS x1, y1 + (det_id % 8) * 125e-3 AS y1,
  x2 + (det_id % 3) * 25e-2 AS x2, y2 + (det_id % 5) * 125e-3 AS y2) FROM whole_det)"""


def fractional(d):
    return d.withColumns({
        "x1": F.col("x1") + (F.col("det_id") % 4) * F.lit(0.25), "y1": F.col("y1") + (F.col("det_id") % 8) * F.lit(0.125),
        "x2": F.col("x2") + (F.col("det_id") % 3) * F.lit(0.25), "y2": F.col("y2") + (F.col("det_id") % 5) * F.lit(0.125),
    })


@query("largest_box", f"""WITH {FRACTIONAL}
SELECT frame_no, det_id FROM (
  SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY (x2 - x1) * (y2 - y1) DESC, det_idx) AS rn FROM fdet) WHERE rn = 1""")
def largest_box(spark, sf_dir):
    d = fractional(fixtures.detections(spark, sf_dir)).withColumn("track_id", F.col("det_idx"))
    return D.largest(d, FRAME).select("frame_no", "det_id")


# Boxes as shares of the frame, some of whose areas differ in the last places only, among very large ones.
NORMALISED = FRACTIONAL + """,
sized AS (SELECT *, CASE WHEN det_id % 50 = 0 THEN 16777216e0 ELSE 390625e-8 END AS k FROM fdet),
ndet AS (SELECT * REPLACE (x1 * k AS x1, y1 * k AS y1, (40e0 + x1) * k + (det_id % 7) * 1e-12 AS x2, (40e0 + y1) * k AS y2) FROM sized)"""


@query("largest_box_normalised", f"""WITH {NORMALISED}
SELECT frame_no, det_id FROM (
  SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY (x2 - x1) * (y2 - y1) DESC, det_idx) AS rn FROM ndet) WHERE rn = 1""")
def largest_box_normalised(spark, sf_dir):
    d = fractional(fixtures.detections(spark, sf_dir)).withColumns({
        "track_id": F.col("det_idx"), "k": F.when(F.col("det_id") % 50 == 0, 16777216.0).otherwise(0.00390625)})
    boxes = d.withColumns({
        "x2": (F.lit(40.0) + F.col("x1")) * F.col("k") + (F.col("det_id") % 7) * F.lit(1e-12), "y2": (F.lit(40.0) + F.col("y1")) * F.col("k"),
        "x1": F.col("x1") * F.col("k"), "y1": F.col("y1") * F.col("k")})
    return D.largest(boxes, FRAME).select("frame_no", "det_id")


@query("target_geometry", f"""WITH {FRACTIONAL},
det AS (SELECT det_id, trunc(x1)::BIGINT AS x1, trunc(y1)::BIGINT AS y1, trunc(x2)::BIGINT AS x2, trunc(y2)::BIGINT AS y2 FROM fdet)
SELECT det_id, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy, (x2 - x1) * (y2 - y1) AS area,
  CASE WHEN abs(ex) < 15e-2 THEN 0e0 WHEN abs(ex) < 35e-2 THEN R6(ex * 5e-1) ELSE R6(ex) END AS error_x,
  CASE WHEN abs(ey) < 15e-2 THEN 0e0 WHEN abs(ey) < 35e-2 THEN R6(ey * 5e-1) ELSE R6(ey) END AS error_y
FROM (SELECT *, ((x1 + x2) // 2 - 100) / 100e0 AS ex, ((y1 + y2) // 2 - 80) / 80e0 AS ey FROM det)""")
def target_geometry(spark, sf_dir):
    error_x, error_y = D.frame_errors(200, 160)
    return fractional(fixtures.detections(spark, sf_dir)).withColumns(D.geometry()).select(
        "det_id", "cx", "cy", "area", F.round(error_x, 6).alias("error_x"), F.round(error_y, 6).alias("error_y"))


# Boxes with tracks: two target boxes per frame, some of them too weak to be seen. The larger is chosen
# by its own area; centre, area and reference are those of the box in whole pixels.
TRACKS = FRACTIONAL + """,
track AS (
  SELECT * REPLACE (trunc(x1)::BIGINT AS x1, trunc(y1)::BIGINT AS y1, trunc(x2)::BIGINT AS x2, trunc(y2)::BIGINT AS y2),
    (det_id // 10) % 4 + 1 AS track_id, (x2 - x1) * (y2 - y1) AS own_area,
    (trunc(x2) - trunc(x1))::BIGINT * (trunc(y2) - trunc(y1))::BIGINT AS area,
    det_idx % 4 = 3 AND conf >= 6e-1 AS is_target FROM fdet)"""


def tracks(spark, sf_dir):
    name = F.when((F.col("det_idx") % 4 == 3) & (F.col("conf") >= 0.6), "car").otherwise("van")
    return fractional(fixtures.detections(spark, sf_dir)).withColumns({
        "track_id": F.expr("(det_id div 10) % 4 + 1"), "class_name": name,
    })


def follow_sql(locked_id=None):
    locked = f"track_id = {locked_id}" if locked_id else "false"
    return f"""WITH {TRACKS},
fr AS (SELECT drone_id, frame_no, us, bool_or(is_target) AS found FROM track GROUP BY drone_id, frame_no, us),
seen AS (SELECT *, lag(us) OVER w AS prev_us, max(CASE WHEN found THEN us END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us
  FROM fr WINDOW w AS (PARTITION BY drone_id ORDER BY us, frame_no)),
held AS (SELECT *, coalesce(prev_us - last_us < 2000000, false) AS held,
  CASE WHEN found THEN 'following' WHEN us - last_us < 2000000 THEN 'lost' ELSE 'searching' END AS state FROM seen),
pick AS (
  SELECT h.*, t.det_id, t.track_id, t.x1, t.y1, t.x2, t.y2, t.area, t.own_area,
    row_number() OVER (PARTITION BY h.drone_id, h.frame_no ORDER BY (h.held AND {locked}) DESC, t.own_area DESC, t.det_idx) AS rn
  FROM held h LEFT JOIN track t ON t.frame_no = h.frame_no AND t.drone_id = h.drone_id AND t.is_target),
one AS (SELECT *, CASE WHEN found AND NOT held THEN 1 ELSE 0 END AS opens FROM pick WHERE rn = 1),
isle AS (SELECT *, sum(opens) OVER (PARTITION BY drone_id ORDER BY us, frame_no) AS isle FROM one),
ref AS (SELECT *, CASE WHEN found THEN first_value(area IGNORE NULLS) OVER (PARTITION BY drone_id, isle ORDER BY us, frame_no) END AS reference_area FROM isle),
err AS (SELECT *, ((x1 + x2) // 2 - 100) / 100e0 AS ex, ((y1 + y2) // 2 - 80) / 80e0 AS ey FROM ref)
SELECT drone_id, frame_no, state, det_id, track_id, area, reference_area,
  R6(CASE WHEN abs(ex) < 15e-2 THEN 0e0 WHEN abs(ex) < 35e-2 THEN ex * 5e-1 ELSE ex END) AS error_x,
  R6(CASE WHEN abs(ey) < 15e-2 THEN 0e0 WHEN abs(ey) < 35e-2 THEN ey * 5e-1 ELSE ey END) AS error_y,
  R6((reference_area - area) / reference_area::DOUBLE) AS error_distance FROM err"""


def _follow(name, locked_id):
    @query(name, follow_sql(locked_id))
    def run(spark, sf_dir):
        f = D.follow(tracks(spark, sf_dir), locked_id=locked_id)
        return f.select("drone_id", "frame_no", "state", "det_id", "track_id", "area", "reference_area",
                        *[F.round(c, 6).alias(c) for c in ("error_x", "error_y", "error_distance")])


_follow("target_following", None)
_follow("target_following_locked", 3)
