"""Depth images: rows of view_idx, u, v, depth, label; cameras as a small table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.transforms import NAMES, applied, applied_inverse
from cloudframe.functions.vectors import INF
from cloudframe.operators.points import validate_points, voxel_downsample

#: Up to so many views are broadcast to the pixels (about 200 bytes each); beyond, the join shuffles.
BROADCAST_VIEWS = 100_000
#: Views that every point meets; of more, those that reach its cell. Cells a side of that grid.
FEW_VIEWS, CELLS = 64, 32
NEAR = 0.05


def small(cameras: DataFrame) -> DataFrame:
    """cameras, to be broadcast if counted to be few."""
    return F.broadcast(cameras) if cameras.limit(BROADCAST_VIEWS + 1).count() <= BROADCAST_VIEWS else cameras


def valid_depth(depth: Column | str = "depth") -> Column:
    """Finite and above zero (NaN counts as greater than infinity in Spark)."""
    d = (F.col(depth) if isinstance(depth, str) else depth).cast("double")
    return F.coalesce((d > 0) & (d < INF), F.lit(False))


def label_filter(labels: Iterable[int] | int | None) -> Column:
    """None keeps all, an int or several keep those, an empty list keeps none."""
    if labels is None:
        return F.lit(True)
    wanted = [labels] if isinstance(labels, int) else list(labels)
    return F.col("label").isin(wanted) if wanted else F.lit(False)


def backproject(pixels: DataFrame, cameras: DataFrame, labels: Iterable[int] | int | None = None, keys: tuple[str, ...] = ("view_idx",)) -> DataFrame:
    """Camera-frame points x, y, z of the valid pixels, beside the pixels' own columns.

    A pixel's place is its centre, u to the right and v down, without half a pixel added.
    """
    kept = pixels.where(valid_depth() & label_filter(labels))
    z = F.col("depth").cast("double")
    joined = kept.join(small(cameras.select(*keys, "fx", "fy", "cx", "cy")), list(keys))
    return joined.withColumns({"x": (F.col("u") - F.col("cx")) * z / F.col("fx"), "y": (F.col("v") - F.col("cy")) * z / F.col("fy"), "z": z}).drop("fx", "fy", "cx", "cy")


def world_points(pixels: DataFrame, cameras: DataFrame, labels: Iterable[int] | int | None = None, keys: tuple[str, ...] = ("view_idx",)) -> DataFrame:
    """World points of the valid pixels of all views, in one pass."""
    kept = pixels.where(valid_depth() & label_filter(labels))
    joined = kept.join(small(cameras.select(*keys, "fx", "fy", "cx", "cy", *NAMES)), list(keys))
    z = F.col("depth").cast("double")
    x, y, z = applied([F.col(n) for n in NAMES], (F.col("u") - F.col("cx")) * z / F.col("fx"), (F.col("v") - F.col("cy")) * z / F.col("fy"), z)
    own = [c for c in pixels.columns if c != "depth"]
    return validate_points(joined.select(*own, x.alias("x"), y.alias("y"), z.alias("z")))


def fuse_views(pixels: DataFrame, cameras: DataFrame, voxel_size: float = 0.003, labels: Iterable[int] | int | None = None, by: tuple[str, ...] = (), keys: tuple[str, ...] = ("view_idx",)) -> DataFrame:
    """All views' points on one voxel grid."""
    return voxel_downsample(world_points(pixels, cameras, labels, keys), voxel_size, by)


def depth_valid_ratio(pixels: DataFrame, cameras: DataFrame, keys: tuple[str, ...] = ("view_idx",)) -> DataFrame:
    """Valid pixels over width x height of each view; labels don't matter; a view without pixels has 0."""
    return per_view_stats(pixels, cameras, None, keys).select(*keys, "depth_valid_ratio")


def per_view_stats(pixels: DataFrame, cameras: DataFrame, labels: Iterable[int] | int | None = None, keys: tuple[str, ...] = ("view_idx",)) -> DataFrame:
    """depth_valid_ratio, valid_depth_point_count and selected_point_count for every view."""
    counts = pixels.where(valid_depth()).groupBy(*keys).agg(F.count("*").alias("valid"), F.count_if(label_filter(labels)).alias("selected"))
    joined = cameras.select(*keys, "width", "height").join(counts, list(keys), "left")
    valid, selected = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("valid", "selected"))
    ratio = F.coalesce(F.try_divide(valid, F.col("width") * F.col("height")), F.lit(0.0))
    return joined.select(*keys, ratio.alias("depth_valid_ratio"), valid.alias("valid_depth_point_count"), selected.alias("selected_point_count"))


def baseline(cameras: DataFrame) -> DataFrame:
    """Distance of the centres of views 0 and 1; 0 if there are fewer."""
    first, second = ([F.max(F.when(F.col("view_idx") == k, F.col(c))) for c in ("tx", "ty", "tz")] for k in (0, 1))
    square = sum(((b - a) * (b - a) for a, b in zip(first, second, strict=True)), F.lit(0.0))
    return cameras.agg(F.coalesce(F.sqrt(square), F.lit(0.0)).alias("baseline_m"))


def project(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixel u, v and depth zc of every world point in every view that sees it.

    Points that aren't finite, nearer than 0.05 or outside the image don't count. Each point meets each of a few
    views; of more, only those that see a part of the point's cell of a coarse grid. Views are
    a table of checked size.
    """
    views = cameras.select("view_idx", "width", "height", "fx", "fy", "cx", "cy", *NAMES)
    n = views.limit(BROADCAST_VIEWS + 1).count()
    if n > BROADCAST_VIEWS:
        raise ValueError(f"more than {BROADCAST_VIEWS} views; project a scene at a time")
    points = validate_points(points)
    seen = points.crossJoin(F.broadcast(views)) if n <= FEW_VIEWS else _in_reach(points, views)
    x, y, z = applied_inverse([F.col(n) for n in NAMES], F.col("x"), F.col("y"), F.col("z"))
    seen = seen.withColumns({"xc": x, "yc": y, "zc": z}).where(F.col("zc") > NEAR)
    u = F.rint(F.col("fx") * F.col("xc") / F.col("zc") + F.col("cx")).cast("bigint")
    v = F.rint(F.col("fy") * F.col("yc") / F.col("zc") + F.col("cy")).cast("bigint")
    placed = seen.withColumns({"u": u, "v": v}).where(F.col("u").between(0, F.col("width") - 1) & F.col("v").between(0, F.col("height") - 1))
    return placed.select("view_idx", "u", "v", "zc", *points.columns, "width", "height")


def _in_reach(points: DataFrame, views: DataFrame) -> DataFrame:
    """points with each view that may see them: whose cell's sphere reaches into the view's pyramid.

    The grid has at most CELLS cells a side, so cells x views stays small beside points x views.
    """
    low, high = ([f(c) for c in "xyz"] for f in (F.min, F.max))
    box = points.agg(*low, *high).first()
    if box[0] is None:
        return points.crossJoin(F.broadcast(views))
    width = max(max(b - a for a, b in zip(box[:3], box[3:], strict=True)) / CELLS, 1e-9)
    keys = ("_cx", "_cy", "_cz")
    celled = points.withColumns({k: F.floor(F.col(c) / width) for k, c in zip(keys, "xyz", strict=True)})
    middles = [(F.col(k) + 0.5) * width for k in keys]
    reach = width * (3**0.5 / 2 + 1e-6)
    x, y, z = applied_inverse([F.col(n) for n in NAMES], *middles)

    def inside(focal: str, edge: Column, place: Column) -> Column:
        """Whether the sphere reaches the inner side of the plane through the eye and an edge of the image."""
        return (F.col(focal) * place + edge * F.col("_z")) >= -reach * F.sqrt(F.col(focal) * F.col(focal) + edge * edge)

    met = celled.select(*keys).distinct().crossJoin(F.broadcast(views)).withColumns({"_x": x, "_y": y, "_z": z}).where(F.col("_z") > NEAR - reach)
    for focal, centre, size, place in (("fx", "cx", "width", "_x"), ("fy", "cy", "height", "_y")):
        met = met.where(inside(focal, F.col(centre) + 0.5, F.col(place)) & inside(focal, F.col(size) - 0.5 - F.col(centre), -F.col(place)))
    return celled.join(met.drop("_x", "_y", "_z"), list(keys)).drop(*keys)


def render(points: DataFrame, cameras: DataFrame, exact: bool = False, splat: int = 1) -> DataFrame:
    """Depth, label and colour of each pixel that points reach: the nearest of those splatted on it.

    Each point covers a square of 2 x splat + 1 pixels. Ties go to the least point_id. The
    depth is kept as float; with `exact` the winner is that of a painter who compares each
    point's double depth with the float already there, nearest first: where rounding to
    float made the nearest depth larger, the farthest point still below it wins label and colour.
    """
    offsets = F.array(*(F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv")) for dv in range(-splat, splat + 1) for du in range(-splat, splat + 1)))
    spread = project(points, cameras).withColumn("o", F.explode(offsets)).withColumns({"u": F.col("u") + F.col("o.du"), "v": F.col("v") + F.col("o.dv")}).drop("o")
    spread = spread.where(F.col("u").between(0, F.col("width") - 1) & F.col("v").between(0, F.col("height") - 1))
    content = F.struct(*(c for c in ("label", "r", "g", "b") if c in points.columns))
    nearest = F.struct("zc", "point_id")
    if not exact:
        out = spread.groupBy("view_idx", "u", "v").agg(F.min("zc").cast("float").alias("depth"), F.min_by(content, nearest).alias("c"))
        return out.select("view_idx", "u", "v", "depth", "c.*")
    least = spread.groupBy("view_idx", "u", "v").agg(F.min("zc").cast("float").alias("depth"), F.min_by(content, nearest).alias("c"))
    later = spread.join(least.select("view_idx", "u", "v", "depth"), ["view_idx", "u", "v"]).where(F.col("zc") < F.col("depth").cast("double"))
    winner = later.groupBy("view_idx", "u", "v").agg(F.max_by(content, F.struct("zc", "point_id")).alias("w"))
    joined = least.join(winner, ["view_idx", "u", "v"], "left").withColumn("c", F.coalesce("w", "c"))
    return joined.select("view_idx", "u", "v", "depth", "c.*")
