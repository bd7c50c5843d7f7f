"""Point clouds: rows of cloud_id, point_id, x, y, z and optional colours r, g, b."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.functions.transforms import applied, literals
from cloudframe.functions.vectors import finite

COLORS = ("r", "g", "b")


def validate_points(points: DataFrame) -> DataFrame:
    """Rows whose three coordinates are finite; a row's colour goes with it."""
    return points.where(finite("x") & finite("y") & finite("z"))


def apply_transform(points: DataFrame, transform: np.ndarray | list[Column]) -> DataFrame:
    """rotation . p + translation, by a 4x4 matrix or twelve columns of the same row."""
    m = literals(transform) if isinstance(transform, np.ndarray) else transform
    x, y, z = applied(m, F.col("x"), F.col("y"), F.col("z"))
    return validate_points(points).withColumns({"x": x, "y": y, "z": z})


def scale_cloud(points: DataFrame, scale: float) -> DataFrame:
    return points.withColumns({c: F.col(c) * F.lit(float(scale)) for c in "xyz"})


def with_voxel_keys(points: DataFrame, size: float) -> DataFrame:
    """Add kx, ky, kz: floor(coordinate / size) as bigint."""
    return points.withColumns({f"k{c}": F.floor(F.col(c) / F.lit(float(size))) for c in "xyz"})


def mean_color(c: str) -> Column:
    """Mean of a colour, cut to 0..255 and truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.avg(c))).cast("smallint").alias(c)


def voxel_downsample(points: DataFrame, size: float | None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a voxel: its key, the mean of its points and colours, and their number n.

    `by` are columns that keep clouds apart. A size of None or at most 0 passes the points
    through. Spark sums up within each task before the shuffle, so a voxel that holds a
    third of all points is no heavier than others. The order is the writer's business.
    """
    if size is None or size <= 0:
        return points
    colors = [mean_color(c) for c in COLORS if c in points.columns]
    means = [F.avg(c).alias(c) for c in "xyz"]
    return with_voxel_keys(validate_points(points), size).groupBy(*by, "kx", "ky", "kz").agg(*means, *colors, F.count("*").alias("n"))


def voxels_by_label(points: DataFrame, size: float) -> DataFrame:
    """Voxels of all points (label null) and of each label, in one pass.

    A voxel may hold several labels, so the voxels of all points are not the labels' union.
    """
    keyed = with_voxel_keys(validate_points(points), size)
    sets = keyed.groupingSets([["kx", "ky", "kz"], ["kx", "ky", "kz", "label"]], "kx", "ky", "kz", "label")
    return sets.agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"), F.grouping("label").alias("all_labels"))


def bounding_box(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """min_*, max_*, extent_* and centre (mean) of each axis, and point_count; 0 for an empty cloud."""
    zero = F.lit(0.0)
    aggregates = [F.count("*").alias("point_count")]
    for c in "xyz":
        aggregates += [F.coalesce(F.min(c), zero).alias(f"min_{c}"), F.coalesce(F.max(c), zero).alias(f"max_{c}"), F.coalesce(F.avg(c), zero).alias(f"centre_{c}")]
    boxes = validate_points(points).groupBy(*by).agg(*aggregates)
    return boxes.withColumns({f"extent_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"})


def sample_points(points: DataFrame, k: int, seed: int = 20260702, by: tuple[str, ...] = ()) -> DataFrame:
    """Exactly k points of each cloud without replacement, the same ones for a seed; all if there are no more.

    The points come in the order of a hash of seed and id. Without `by` that is a top-k,
    which each task cuts to k rows before they meet; k is a working cloud's size, which fits
    one task.
    """
    if k <= 0 or not by and points.count() <= k:
        return points
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("point_id")))
    if not by:
        return points.orderBy(order, "point_id").limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, "point_id"))
    return points.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def working_points(points: DataFrame, size: float | None, k: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Voxel means, then at most k of them; point_id is the voxel's place on the grid.

    The three keys go into one number side by side, 21 bits each; a voxel farther than a million
    from the origin's is an error, never another one's id.
    """
    if size is not None and size > 0:
        points = voxel_downsample(points, size, by)
        half = 1 << 20
        places = [F.when(F.col(k).between(-half, half - 1), F.col(k) + half).otherwise(F.raise_error(F.lit("more than two million voxels a side; take a larger voxel"))).cast("bigint") for k in ("kx", "ky", "kz")]
        points = points.withColumn("point_id", F.shiftleft(places[0], 42) + F.shiftleft(places[1], 21) + places[2])
    return sample_points(points, k, seed, by)


def concat_clouds(clouds: list[DataFrame]) -> DataFrame:
    """UNION ALL; colours stay only if all clouds have them."""
    colored = all(set(COLORS) <= set(c.columns) for c in clouds)
    names = ["cloud_id", "point_id", "x", "y", "z"]
    kept = [c.select(*(n for n in names if n in c.columns), *(COLORS if colored else ())) for c in clouds]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
