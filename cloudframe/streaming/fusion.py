"""Voxel fusion of a stream of pixels, beyond what a batch job gives: the grid kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.transforms import NAMES, applied
from cloudframe.operators.depth import small, valid_depth
from cloudframe.operators.points import voxel_downsample


def fuse_stream(pixels: DataFrame, cameras: DataFrame, voxel_size: float, time_col: str | None = None, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Voxels of a streaming DataFrame of pixels; cameras is a static table of a few views.

    Without time_col the grid covers everything seen so far (output modes update, complete).
    With it there is a grid for each window, which closes once the watermark has passed
    (append), so the state stays bounded.
    """
    joined = pixels.where(valid_depth()).join(small(cameras.select("view_idx", "fx", "fy", "cx", "cy", *NAMES)), "view_idx")
    z = F.col("depth").cast("double")
    x, y, z = applied([F.col(n) for n in NAMES], (F.col("u") - F.col("cx")) * z / F.col("fx"), (F.col("v") - F.col("cy")) * z / F.col("fy"), z)
    points = joined.select(*([time_col] if time_col else []), x.alias("x"), y.alias("y"), z.alias("z"))
    if time_col is None:
        return voxel_downsample(points, voxel_size)
    timed = points.withWatermark(time_col, late).withColumn("window", F.window(time_col, window))
    return voxel_downsample(timed, voxel_size, ("window",))
