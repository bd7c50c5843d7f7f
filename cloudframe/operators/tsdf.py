"""A sparse volume of truncated signed distances from depth images, and its surface as triangles.

The volume is a table of voxels near a surface, keyed by a block of BLOCK voxels a side and the
voxel's place on the grid; a block is what queries and partitions cut by. Nothing is dense.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.transforms import NAMES, applied, applied_inverse
from cloudframe.operators.depth import small, valid_depth

BLOCK = 8
KEYS = ("kx", "ky", "kz")


def rays(pixels: DataFrame, cameras: DataFrame, voxel: float, steps: int) -> DataFrame:
    """view_idx, kx, ky, kz: the voxels that a valid pixel's ray runs through within `steps` half voxels of its depth."""
    joined = pixels.where(valid_depth()).join(small(cameras.select("view_idx", "fx", "fy", "cx", "cy", *NAMES)), "view_idx")
    along = joined.withColumn("s", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn("z", F.col("depth").cast("double") + F.col("s") * (voxel / 2)).where("z > 0")
    x, y, z = applied([F.col(n) for n in NAMES], (F.col("u") - F.col("cx")) * F.col("z") / F.col("fx"), (F.col("v") - F.col("cy")) * F.col("z") / F.col("fy"), F.col("z"))
    return along.select("view_idx", *(F.floor(c / F.lit(voxel)).alias(k) for k, c in zip(KEYS, (x, y, z), strict=True))).distinct()


def integrate(pixels: DataFrame, cameras: DataFrame, voxel: float, truncation: float) -> DataFrame:
    """bx, by, bz, kx, ky, kz, tsdf, weight: for each voxel near a surface the mean signed distance, in truncations, of the views that see it.

    A voxel's middle is projected to its pixel in each view whose rays reach it; the depth there
    less the middle's own is its distance, cut to one truncation in front, and left out if it is more
    than one behind. weight counts the views. Work is in proportion to pixels x truncation.
    """
    near = rays(pixels, cameras, voxel, int(np.ceil(2 * truncation / voxel)))
    views = small(cameras.select("view_idx", "fx", "fy", "cx", "cy", *NAMES))
    middles = [(F.col(k) + 0.5) * voxel for k in KEYS]
    # A voxel that one view's rays reach is looked at by every view whose rays reach it; others add nothing near the surface.
    x, y, z = applied_inverse([F.col(n) for n in NAMES], *middles)
    seen = near.join(views, "view_idx").withColumns({"_x": x, "_y": y, "_z": z}).where("_z > 0")
    u = F.rint(F.col("_x") * F.col("fx") / F.col("_z") + F.col("cx")).cast("bigint")
    v = F.rint(F.col("_y") * F.col("fy") / F.col("_z") + F.col("cy")).cast("bigint")
    image = pixels.where(valid_depth()).select("view_idx", F.col("u").cast("bigint").alias("pu"), F.col("v").cast("bigint").alias("pv"), F.col("depth").cast("double").alias("d"))
    met = seen.select("view_idx", *KEYS, "_z", u.alias("pu"), v.alias("pv")).join(image, ["view_idx", "pu", "pv"])
    signed = (F.col("d") - F.col("_z")) / truncation
    kept = met.withColumn("t", signed).where("t >= -1")
    volume = kept.groupBy(*KEYS).agg(F.avg(F.least(F.col("t"), F.lit(1.0))).alias("tsdf"), F.count("*").alias("weight"))
    return volume.select(*(F.floor(F.col(k) / BLOCK).alias(f"b{k[1]}") for k in KEYS), *KEYS, "tsdf", "weight")


def merge_volumes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both volumes on one grid: distances averaged by weight."""
    both = first.unionByName(second)
    return both.groupBy("bx", "by", "bz", *KEYS).agg((F.sum(F.col("tsdf") * F.col("weight")) / F.sum("weight")).alias("tsdf"), F.sum("weight").alias("weight"))


CORNERS = list(itertools.product((0, 1), repeat=3))
#: Six tetrahedra around a cell's diagonal: along the three axes in each of their orders.
TETRAHEDRA = [[0, 1 << (2 - a), (1 << (2 - a)) | (1 << (2 - b)), 7] for a, b, _ in itertools.permutations(range(3))]


def surface(volume: DataFrame, voxel: float, least: int = 1) -> DataFrame:
    """triangle (an array of three [x, y, z]) of the surface of distance zero, and the cell (kx, ky, kz) it lies in.

    A cell lies between eight voxels' middles, all of which have to be known by `least` views. It
    is cut into six tetrahedra; each gives no, one or two triangles, interpolated along its edges, that
    face the outside. Cells meet their corners by one grouping; there is no order between them.
    """
    offsets = F.explode(F.array(*(F.struct(F.lit(k).alias("corner"), *(F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True))) for k, o in enumerate(CORNERS))))
    told = volume.where(F.col("weight") >= least).select(*KEYS, "tsdf", offsets.alias("o"))
    told = told.select(*((F.col(k) - F.col(f"o.{k[1]}")).alias(k) for k in KEYS), F.col("o.corner").alias("corner"), "tsdf")

    def corner(k: int) -> Column:
        return F.max(F.when(F.col("corner") == k, F.col("tsdf"))).alias(f"c{k}")

    cells = told.groupBy(*KEYS).agg(F.count("*").alias("n"), *map(corner, range(8)))
    values = [F.col(f"c{k}") for k in range(8)]
    crossed = cells.where((F.col("n") == 8) & (F.least(*values) < 0) & (F.greatest(*values) >= 0)).drop("n")

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            value = np.stack([batch.column(3 + k).to_numpy() for k in range(8)], axis=1)
            rows, found = cut_cells((cell + 0.5) * voxel, value, voxel)
            kept = [pa.array(np.ascontiguousarray(cell[rows, k])) for k in range(3)]
            n = len(rows)
            points = pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * n + 1, 3, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), points)], [*KEYS, "triangle"])

    return crossed.mapInArrow(triangles, "kx bigint, ky bigint, kz bigint, triangle array<array<double>>")


def cut_cells(low: np.ndarray, value: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell, triangle: 3 x 3) of cells with their least corners and eight values each."""
    places = low[:, None, :] + np.array(CORNERS, float) * width
    out_rows, out = [np.zeros(0, np.int64)], [np.zeros((0, 3, 3))]
    for corners in TETRAHEDRA:
        p, v = places[:, corners], value[:, corners]
        inside = v < 0
        for count in (1, 2, 3):
            rows = np.flatnonzero(inside.sum(axis=1) == count)
            if not len(rows):
                continue
            order = np.argsort(~inside[rows], axis=1, kind="stable")  # inner corners first
            q, w = np.take_along_axis(p[rows], order[:, :, None], 1), np.take_along_axis(v[rows], order, 1)

            def between(a: int, b: int, q: np.ndarray = q, w: np.ndarray = w) -> np.ndarray:
                share = (w[:, a] / (w[:, a] - w[:, b]))[:, None]
                return q[:, a] + (q[:, b] - q[:, a]) * share

            cut = [between(a, b) for a in range(count) for b in range(count, 4)]
            found = [(cut[0], cut[1], cut[2])] if count != 2 else [(cut[0], cut[1], cut[2]), (cut[1], cut[3], cut[2])]
            outward = q[:, count:].mean(axis=1) - q[:, :count].mean(axis=1)
            for three in found:
                triangle = np.stack(three, axis=1)
                normal = np.cross(triangle[:, 1] - triangle[:, 0], triangle[:, 2] - triangle[:, 0])
                wrong = (normal * outward).sum(axis=1) < 0
                triangle[wrong] = triangle[wrong][:, [0, 2, 1]]
                real = (normal != 0).any(axis=1)
                out_rows.append(rows[real])
                out.append(triangle[real])
    return np.concatenate(out_rows), np.concatenate(out)
