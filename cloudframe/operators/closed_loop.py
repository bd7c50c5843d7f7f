"""Does a reconstruction explain what was seen: reprojected joints, depth residuals, and distances between clouds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.vectors import finite
from cloudframe.operators.depth import small, valid_depth
from cloudframe.operators.neighbours import nearest_any
from cloudframe.operators.order import summary
from cloudframe.operators.points import validate_points, with_voxel_keys
from cloudframe.operators.tables import broadcast_if_few

# What a reprojection and a depth residual may be for a frame to pass, in pixels and metres.
MEAN_PX, P95_PX, MEAN_M = 5.0, 15.0, 0.010


def joint_rows(hands: DataFrame, *keys: str) -> DataFrame:
    """The keys, joint, x, y, z of the valid joints that are finite and before the camera."""
    mask = F.col("valid_joint_mask") if "valid_joint_mask" in hands.columns else F.expr("array_repeat(true, 21)")
    rows = hands.select(*keys, F.posexplode(F.arrays_zip(F.col("joints_3d_left_m").alias("p"), mask.alias("m"))).alias("joint", "j")).where("j.m")
    rows = rows.select(*keys, "joint", *(F.col("j.p")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return validate_points(rows).where("z > 0")


def reproject_stereo(joints: DataFrame, fx: float, fy: float, cx: float, cy: float, baseline_m: float) -> DataFrame:
    """Add left_u, left_v, right_u, right_v: where the two rectified cameras see a joint; the right one lies baseline_m to the right."""
    v = F.col("y") * fy / F.col("z") + cy
    return joints.withColumns({"left_u": F.col("x") * fx / F.col("z") + cx, "left_v": v, "right_u": (F.col("x") - baseline_m) * fx / F.col("z") + cx, "right_v": v})


def reprojection_errors(projected: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """keys, joint, side (left, right), error in pixels, of the joints that were observed in an image.

    observed has the keys, joint, side, u, v; without a place an observation doesn't count.
    """
    sides = F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_u").alias("pu"), F.col(f"{s}_v").alias("pv")) for s in ("left", "right"))))
    seen = observed.where(finite("u") & finite("v")).select(*keys, "joint", "side", "u", "v")
    pairs = projected.select(*keys, "joint", sides).join(seen, [*keys, "joint", "side"])
    du, dv = F.col("pu") - F.col("u"), F.col("pv") - F.col("v")
    return pairs.select(*keys, "joint", "side", F.sqrt(du * du + dv * dv).alias("error"))


def grouped_errors(errors: DataFrame, *by: str) -> DataFrame:
    """count, mean, median and p95 of `error` in each group; a group is a frame or a joint of a clip, few enough for one task."""
    return errors.groupBy(*by).agg(F.count("*").alias("count"), F.avg("error").alias("mean"), F.percentile("error", 0.5).alias("median"), F.percentile("error", 0.95).alias("p95"))


def overall_errors(errors: DataFrame) -> DataFrame:
    """count, mean, median and p95 of all errors, any number of them."""
    return summary(errors, [F.count("*").alias("count"), F.avg("error").alias("mean")], {"median": ("error", 0.5), "p95": ("error", 0.95)})


def frames_passed(errors: DataFrame, *by: str, mean: float = MEAN_PX, p95: float | None = P95_PX) -> DataFrame:
    """grouped_errors() with `passed`: mean and 95th percentile below what is allowed."""
    rule = F.col("mean") < mean
    return grouped_errors(errors, *by).withColumn("passed", rule if p95 is None else rule & (F.col("p95") < p95))


def depth_residuals(points: DataFrame, pixels: DataFrame, cameras: DataFrame, front: float = 0.05, views: tuple[str, ...] = ("view_idx",)) -> DataFrame:
    """points (view_idx, x, y, z in the view's camera frame) with u, v, surface, residual, occluded.

    surface is the depth at the point's exact place, interpolated between the four pixels around
    it; they all have to be valid. A point more than `front` behind the surface is occluded,
    and has no residual; else it is abs(z - surface). Pixels meet the points by their corners, so
    the image is joined once and only where points look.
    """
    seen = validate_points(points).where("z > 0").withColumn("_id", F.monotonically_increasing_id())
    seen = seen.join(small(cameras.select(*views, "fx", "fy", "cx", "cy")), list(views))
    u, v = F.col("x") * F.col("fx") / F.col("z") + F.col("cx"), F.col("y") * F.col("fy") / F.col("z") + F.col("cy")
    placed = seen.withColumns({"u": u, "v": v}).drop("fx", "fy", "cx", "cy")
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    asked = placed.select("_id", *views, "u", "v", corners.alias("k"))
    asked = asked.select("_id", *views, (F.floor("u") + F.col("k.a")).alias("pu"), (F.floor("v") + F.col("k.b")).alias("pv"), *(F.when(F.col(f"k.{k}") == 1, F.col(c) - F.floor(c)).otherwise(F.floor(c) + 1 - F.col(c)).alias(f"w{c}") for k, c in (("a", "u"), ("b", "v"))))
    image = pixels.where(valid_depth()).select(*views, F.col("u").cast("bigint").alias("pu"), F.col("v").cast("bigint").alias("pv"), F.col("depth").cast("double").alias("d"))
    met = asked.join(image, [*views, "pu", "pv"]).groupBy("_id").agg(F.count("*").alias("n"), F.sum(F.col("wu") * F.col("wv") * F.col("d")).alias("surface")).where("n = 4")
    out = placed.join(met.drop("n"), "_id").drop("_id")
    out = out.withColumn("occluded", F.col("z") - F.col("surface") > front)
    return out.withColumn("residual", F.when(~F.col("occluded"), F.abs(F.col("z") - F.col("surface"))))


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean distance and mean squared distance to the other cloud's nearest points, each way, and chamfer_l2_m, their roots' mean."""
    ways = []
    for name, source, target in (("ab", a, b), ("ba", b, a)):
        d = F.col("distance")
        found = nearest_any(source.select("point_id", *"xyz"), target.select("point_id", *"xyz"))
        ways.append(found.agg(F.count("*").alias(f"count_{name}"), F.avg(d).alias(f"mean_{name}_m"), F.avg(d * d).alias(f"square_{name}")))
    both = ways[0].crossJoin(ways[1])  # one row each
    return both.withColumn("chamfer_l2_m", (F.sqrt("square_ab") + F.sqrt("square_ba")) / 2)


MOMENTS = ["n", *(f"s{c}" for c in "xyz"), *(f"s{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))]


def cell_normals(points: DataFrame, size: float, least: int = 5) -> DataFrame:
    """kx, ky, kz, nx, ny, nz, flatness: the normal of the points in each occupied cell and the 26 around it.

    Cells pass on sums about their own middles, not points, so a crowded cell is one row to its
    neighbours. The normal is the direction of least spread, its last component that isn't zero
    positive; flatness is the share of that spread in all. Fewer than `least` points have none.
    """
    middle = {c: (F.col(f"k{c}") + 0.5) * size for c in "xyz"}
    local = with_voxel_keys(validate_points(points), size).withColumns({f"_{c}": F.col(c) - m for c, m in middle.items()})
    pairs = [(p, q) for k, p in enumerate("xyz") for q in "xyz"[k:]]
    sums = local.groupBy("kx", "ky", "kz").agg(F.count("*").cast("double").alias("n"), *(F.sum(f"_{c}").alias(f"s{c}") for c in "xyz"), *(F.sum(F.col(f"_{p}") * F.col(f"_{q}")).alias(f"s{p}{q}") for p, q in pairs))
    steps = F.array(*(F.struct(*(F.lit(float(d)).alias(c) for d, c in zip((x, y, z), "xyz", strict=True))) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)))
    told = sums.withColumn("d", F.explode(steps))
    off = {c: -F.col(f"d.{c}") * size for c in "xyz"}  # this cell's middle, seen from the neighbour's
    moved = {f"s{c}": F.col(f"s{c}") + F.col("n") * off[c] for c in "xyz"}
    moved |= {f"s{p}{q}": F.col(f"s{p}{q}") + off[p] * F.col(f"s{q}") + off[q] * F.col(f"s{p}") + F.col("n") * off[p] * off[q] for p, q in pairs}
    to = told.select(*((F.col(f"k{c}") + F.col(f"d.{c}").cast("bigint")).alias(f"k{c}") for c in "xyz"), "n", *(e.alias(k) for k, e in moved.items()))
    around = to.groupBy("kx", "ky", "kz").agg(*(F.sum(m).alias(m) for m in MOMENTS)).where(F.col("n") >= least)
    around = around.join(sums.select("kx", "ky", "kz"), ["kx", "ky", "kz"], "left_semi")

    def normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = {name: batch.column(3 + k).to_numpy() for k, name in enumerate(MOMENTS)}
            spread = np.zeros((batch.num_rows, 3, 3))
            for i, p in enumerate("xyz"):
                for j, q in enumerate("xyz"):
                    spread[:, i, j] = m[f"s{min(p, q)}{max(p, q)}"] / m["n"] - m[f"s{p}"] / m["n"] * m[f"s{q}"] / m["n"]
            values, vectors = np.linalg.eigh(spread)
            normal = vectors[:, :, 0]
            last = 2 - np.argmax(np.abs(normal[:, ::-1]) > 1e-9, axis=1)
            normal = normal * np.where(normal[np.arange(len(normal)), last] < 0, -1.0, 1.0)[:, None]
            total = values.sum(axis=1)
            flat = np.divide(np.maximum(values[:, 0], 0), total, out=np.zeros(len(total)), where=total > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(c)) for c in normal.T), pa.array(flat)], ["kx", "ky", "kz", "nx", "ny", "nz", "flatness"])

    return around.mapInArrow(normals, "kx bigint, ky bigint, kz bigint, nx double, ny double, nz double, flatness double")


def point_to_plane(pairs: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """pairs (x, y, z, tx, ty, tz) with `plane_distance`, that of the point from the plane through its target; null where the target has no normal."""
    normals = broadcast_if_few(cell_normals(target, size).select(*(F.col(f"k{c}").alias(f"_k{c}") for c in "xyz"), "nx", "ny", "nz"))
    keyed = pairs.withColumns({f"_k{c}": F.floor(F.col(f"t{c}") / F.lit(float(size))) for c in "xyz"})
    along: Column = sum(((F.col(c) - F.col(f"t{c}")) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))
    return keyed.join(normals, ["_kx", "_ky", "_kz"], "left").withColumn("plane_distance", F.abs(along)).select(*pairs.columns, "plane_distance")


def cloud_report(source: DataFrame, target: DataFrame, size: float, near: float) -> DataFrame:
    """One row: icp_rmse_m and icp_fitness of the pairs at most `near` apart, and point_to_plane_rmse_m of those with a normal."""
    total = validate_points(source).count()
    pairs = nearest_any(source.select("point_id", *"xyz"), target.select("point_id", *"xyz")).where(F.col("distance") <= near)
    d, p = F.col("distance"), F.col("plane_distance")
    return point_to_plane(pairs, target, size).agg(F.count("*").alias("pair_count"), (F.count("*") / F.lit(float(max(1, total)))).alias("icp_fitness"), F.sqrt(F.avg(d * d)).alias("icp_rmse_m"), F.sqrt(F.avg(p * p)).alias("point_to_plane_rmse_m"))
