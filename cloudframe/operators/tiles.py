"""Tiles of point clouds by frame, for playback: an octree's leaves hold every point once, its inner nodes a bounded sample.

A tile is (frame, level, kx, ky, kz): the box of edge side / 2^level at that place of the grid. A
viewer reads a frame's coarse tiles first and then those it looks at; as a table the tiles are
partitioned by frame and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.operators.points import validate_points
from cloudframe.operators.tables import broadcast_if_few

#: Levels at most below the root, and the bits of a place on the finest grid.
DEPTH = 12
PLACE = ("kx", "ky", "kz")


def with_cells(points: DataFrame, low: tuple[float, float, float], side: float) -> DataFrame:
    """points with c_kx, c_ky, c_kz, their place on the finest grid of the cube at low; what lies outside goes to its border."""
    most = (1 << DEPTH) - 1
    cells = {f"c_{k}": F.least(F.greatest(F.floor((F.col(k[1]) - F.lit(o)) / F.lit(side) * (1 << DEPTH)), F.lit(0)), F.lit(most)).cast("bigint") for k, o in zip(PLACE, low, strict=True)}
    return points.withColumns(cells)


def at_level(level: Column) -> list[Column]:
    """The place of the node of a level that a cell lies in."""
    return [F.expr(f"shiftright(c_{k}, {DEPTH} - level)").alias(k) for k in PLACE]


def nodes(celled: DataFrame) -> DataFrame:
    """frame, level, kx, ky, kz, n of every node that has a point, the root's level 0. Counted by finest cells first, then level by level."""
    finest = celled.groupBy("frame", *(f"c_{k}" for k in PLACE)).agg(F.count("*").alias("n"))
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
    return levels.select("frame", "level", *at_level(F.col("level")), "n").groupBy("frame", "level", *PLACE).agg(F.sum("n").alias("n"))


def tile_points(points: DataFrame, low: tuple[float, float, float], side: float, most: int) -> DataFrame:
    """points (frame, point_id, x, y, z, ...) with level, kx, ky, kz, is_leaf: each in its leaf once, and in inner nodes where it is of their sample.

    A leaf is the first node on a point's way down with at most `most` points, or the node of the last
    level. An inner node's sample are its points of least hash, `most` at the most; those of a node
    are among those of its children, so a viewer only ever adds points. The sample's candidates are cut to
    about twice as many by their hash before any are ordered, so no node meets in one task.
    """
    celled = with_cells(validate_points(points), low, side)
    counted = nodes(celled)
    inner = counted.where((F.col("n") > most) & (F.col("level") < DEPTH))
    cells = celled.select("frame", *(f"c_{k}" for k in PLACE)).distinct()
    ways = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))).withColumns({k: c for k, c in zip(PLACE, at_level(F.col("level")), strict=True)})
    keys = ["frame", "level", *PLACE]
    depth = ways.join(broadcast_if_few(inner.select(*keys)), keys, "left_semi").groupBy("frame", *(f"c_{k}" for k in PLACE)).agg((F.max("level") + 1).alias("leaf"))
    placed = celled.join(broadcast_if_few(depth), ["frame", *(f"c_{k}" for k in PLACE)], "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    own = points.columns

    def at(rows: DataFrame) -> DataFrame:
        return rows.withColumns({k: c for k, c in zip(PLACE, at_level(F.col("level")), strict=True)})

    leaves = at(placed.withColumn("level", F.col("leaf"))).select(*own, "level", *PLACE, F.lit(True).alias("is_leaf"))
    share = F.pmod(F.xxhash64("frame", "point_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    above = at(placed.where("leaf > 0").withColumn("_share", share).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("leaf") - 1))))
    near = above.join(broadcast_if_few(inner), keys).where(F.col("_share") < F.lit(2.0 * most) / F.col("n"))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_share", "point_id"))).where(F.col("_rank") <= most)
    return leaves.unionByName(ranked.select(*own, "level", *PLACE, F.lit(False).alias("is_leaf")))


def write_tiles(tiles: DataFrame, folder: str, mode: str = "error") -> None:
    """The tiles as a table by frame and level; a tile's rows stand together in its file, in order of place."""
    tiles.repartition("frame", "level", *PLACE).sortWithinPartitions("frame", "level", *PLACE).write.partitionBy("frame", "level").mode(mode).parquet(folder)
