"""Synthetic surfaces, scenes and registration clouds, generated on the executors from ranges."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.functions.transforms import look_at, numbers
from cloudframe.operators.depth import render
from cloudframe.schemas import CAMERAS, LABELS, local_table

TAU = 2 * math.pi

# The mock scene's parts.
PALM = ((-0.055, -0.015, 0.405), (0.038, 0.022, 0.052), 42, 22)
FINGER_X = (-0.085, -0.067, -0.049, -0.031, -0.016)
FINGER_LENGTHS = (0.052, 0.068, 0.076, 0.066, 0.052)
FINGER_RADII = (0.0065, 0.0070, 0.0072, 0.0067, 0.0058)
THUMB = ((-0.086, -0.016, 0.395), (-0.050, 0.014, 0.038), 0.008, 32, 20)
BOX = ((0.075, 0.025, 0.405), (0.070, 0.054, 0.060), 22)
LID = ((0.075, 0.025, 0.458), (0.028, 0.028, 0.016), 30, 16)
HAND_COLOR, OBJECT_COLOR = (230, 172, 128), (70, 135, 230)
NOISE, SEED = 0.0005, 20260707
# The registration hand. A palm: half axes, shift, ripple of x with three waves. Tubes: start, run,
# radius, the axis that goes round with x; all are arched in z.
ICP_PALM, ICP_SHIFT, ICP_RIPPLE, ICP_PALM_POINTS = (0.035, 0.043, 0.016), (0.0, -0.012, 0.0), 0.004, 900
ICP_TUBES = (
    ((-0.028, 0.018, 0.0), (-0.006, 0.052, 0.0), 0.0065, "z"),
    ((-0.012, 0.018, 0.0), (-0.003, 0.074, 0.0), 0.0068, "z"),
    ((0.004, 0.018, 0.0), (0.0, 0.082, 0.0), 0.0072, "z"),
    ((0.019, 0.018, -0.003), (0.003, 0.073, 0.0), 0.0065, "z"),
    ((0.032, 0.018, -0.006), (0.006, 0.058, 0.0), 0.0058, "z"),
    ((-0.034, -0.006, -0.002), (-0.045, 0.035, 0.0), 0.007, "y"),
)
ICP_ARCH, ICP_TUBE_POINTS = 0.004, 420


def steps(index: Column, n: int, low: float, high: float) -> Column:
    """The index-th of n even steps from low to high, both included."""
    return F.lit(float(low)) + index * F.lit((high - low) / max(1, n - 1))


def number(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def shape_points(shapes: DataFrame, n: int) -> DataFrame:
    """Each row of shapes n times, with point_id from 0: the grid of a shape a row, whose centre may then be the row's columns."""
    return shapes.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("point_id", F.col("point_id").cast("bigint"))


def ellipsoid(spark: SparkSession, center: tuple, radii: tuple, around: int, along: int, shapes: DataFrame | None = None) -> DataFrame:
    """around x along points of an ellipsoid without its poles; point_id counts around first. With shapes, one for each of their rows."""
    grid = spark.range(around * along).withColumnRenamed("id", "point_id") if shapes is None else shape_points(shapes, around * along)
    u, v = (F.col("point_id") % around) * F.lit(TAU / around), steps(F.floor(F.col("point_id") / around), along, 0.08 * math.pi, 0.92 * math.pi)
    parts = {"x": F.cos(u) * F.sin(v), "y": F.sin(u) * F.sin(v), "z": F.cos(v)}
    return grid.withColumns({c: part * number(r) + number(o) for (c, part), r, o in zip(parts.items(), radii, center, strict=True)})


def cylinder(spark: SparkSession, base: tuple, axis: tuple, radius: float, height_steps: int, angle_steps: int, shapes: DataFrame | None = None) -> DataFrame:
    """Rings of a cylinder's shell; point_id counts along the axis first. With shapes, one for each of their rows."""
    a = np.asarray(axis, float)
    direction = a / np.linalg.norm(a)
    helper = np.array([0.0, 1.0, 0.0] if abs(direction[2]) > 0.92 else [0.0, 0.0, 1.0])
    first = np.cross(direction, helper)
    first /= np.linalg.norm(first)
    second = np.cross(direction, first)
    grid = spark.range(height_steps * angle_steps).withColumnRenamed("id", "point_id") if shapes is None else shape_points(shapes, height_steps * angle_steps)
    t, angle = steps(F.col("point_id") % height_steps, height_steps, 0, 1), F.floor(F.col("point_id") / height_steps) * F.lit(TAU / angle_steps)
    return grid.withColumns({c: number(base[k]) + t * F.lit(float(a[k])) + F.cos(angle) * F.lit(radius * float(first[k])) + F.sin(angle) * F.lit(radius * float(second[k])) for k, c in enumerate("xyz")})


def box(spark: SparkSession, center: tuple, size: tuple, n: int, shapes: DataFrame | None = None) -> DataFrame:
    """n x n points on each of six faces, edges twice; faces in the order z, y, x, low before high. With shapes, one for each of their rows."""
    grid = spark.range(6 * n * n).withColumnRenamed("id", "point_id") if shapes is None else shape_points(shapes, 6 * n * n)
    face, cell = F.floor(F.col("point_id") / (n * n)), F.col("point_id") % (n * n)
    fixed = F.lit(2) - F.floor(face / 2)
    row, column = F.floor(cell / n), cell % n
    out = {}
    for k, c in enumerate("xyz"):
        half = size[k] / 2
        side = F.when(face % 2 == 0, F.lit(-half)).otherwise(F.lit(half))
        free = column if k == 0 else row if k == 2 else F.when(fixed == 0, column).otherwise(row)
        out[c] = F.when(fixed == k, side).otherwise(steps(free, n, -half, half)) + number(center[k])
    return grid.withColumns(out)


def _together(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL with the point_ids of the parts one after another."""
    out, start = None, 0
    for part in parts:
        moved = part.select((F.col("point_id") + start).alias("point_id"), "x", "y", "z")
        start += part.count()
        out = moved if out is None else out.unionByName(moved)
    return out


def mock_points(spark: SparkSession, noise: float = NOISE, seed: int = SEED) -> DataFrame:
    """point_id, x, y, z, label, r, g, b of the mock hand (noisy) and object."""
    fingers = [cylinder(spark, (x, -0.012 + 0.002 * k, 0.445), (0.006 * (k - 2), 0.002, length), radius, 38, 20) for k, (x, length, radius) in enumerate(zip(FINGER_X, FINGER_LENGTHS, FINGER_RADII, strict=True))]
    hand = _together([ellipsoid(spark, *PALM), *fingers, cylinder(spark, *THUMB)])
    hand = hand.withColumns({c: F.col(c) + F.randn(seed + k) * noise for k, c in enumerate("xyz")})
    other = _together([box(spark, *BOX), ellipsoid(spark, *LID)]).withColumn("point_id", F.col("point_id") + 1_000_000)

    def marked(points: DataFrame, label: str, color: tuple) -> DataFrame:
        return points.withColumn("label", F.lit(LABELS[label]).cast("smallint")).withColumns({c: F.lit(v).cast("smallint") for c, v in zip("rgb", color, strict=True)})

    return marked(hand, "hand", HAND_COLOR).unionByName(marked(other, "object", OBJECT_COLOR))


def ring_cameras(spark: SparkSession, views: int, width: int = 128, height: int = 96, focal: float = 118.0, scene_id: str = "rgbd_scene_001", radius: float = 0.64, up: float = 0.46, target: tuple = (0.0, 0.0, 0.43)) -> DataFrame:
    """schemas.CAMERAS of views on a ring around the target, looking at it."""
    rows = []
    for k in range(views):
        angle = TAU * k / max(1, views) + math.pi / 4
        pose = look_at(np.array([radius * math.cos(angle), radius * math.sin(angle), up]), np.array(target))
        rows.append((scene_id, k, f"view_{k:02d}", width, height, focal, focal, (width - 1) / 2, (height - 1) / 2, *numbers(pose), "2026-07-07T00:00:00+08:00"))
    return local_table(spark, rows, CAMERAS)


def mock_scene(spark: SparkSession, views: int = 4, points: DataFrame | None = None, **camera) -> tuple[DataFrame, DataFrame]:
    """(pixels, cameras): the mock points, or those given, rendered into every view, empty pixels with depth 0."""
    cameras = ring_cameras(spark, views, **camera)
    seen = render(mock_points(spark) if points is None else points, cameras, exact=True)
    places = cameras.select("scene_id", "view_idx", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k"), "width")
    places = places.select("scene_id", "view_idx", F.floor(F.col("k") / F.col("width")).cast("int").alias("v"), (F.col("k") % F.col("width")).cast("int").alias("u"))
    pixels = places.join(seen.withColumns({c: F.col(c).cast("int") for c in ("u", "v")}), ["view_idx", "u", "v"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("smallint") for c in ("label", "r", "g", "b")}
    return pixels.withColumns(zero).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("float")).select("scene_id", "view_idx", "v", "u", "depth", "label", "r", "g", "b"), cameras


def registration_hand(spark: SparkSession, seed: int = 7, noise: float = 0.0006) -> DataFrame:
    """3,420 points: a palm, five bent fingers and a thumb, of random places and noise."""
    def placed(n: int, part: int, place: dict[str, Column]) -> DataFrame:
        drawn = spark.range(n, numPartitions=1).select(F.col("id").alias("point_id"), F.rand(seed + 10 * part).alias("s"), F.rand(seed + 10 * part + 1).alias("t"))
        return drawn.select("point_id", *(c.alias(axis) for axis, c in place.items()))

    around, along = F.col("s") * TAU, F.col("t")
    polar = F.acos(along * 2 - 1)
    ball = {"x": F.sin(polar) * F.cos(around), "y": F.sin(polar) * F.sin(around), "z": F.cos(polar)}
    palm = {axis: c * half + shift for (axis, c), half, shift in zip(ball.items(), ICP_PALM, ICP_SHIFT, strict=True)}
    parts = [placed(ICP_PALM_POINTS, 0, palm | {"x": palm["x"] + F.sin(around * 3) * ICP_RIPPLE})]
    for k, (start, run, radius, second) in enumerate(ICP_TUBES, 1):
        ring = {"x": F.cos(around) * radius, second: F.sin(around) * radius}
        tube = {axis: along * step + begin + ring.get(axis, F.lit(0.0)) for axis, begin, step in zip("xyz", start, run, strict=True)}
        parts.append(placed(ICP_TUBE_POINTS, k, tube | {"z": tube["z"] + F.sin(along * math.pi) * ICP_ARCH}))
    return _together(parts).withColumns({c: F.col(c) + F.randn(seed + 100 + k) * noise for k, c in enumerate("xyz")})
