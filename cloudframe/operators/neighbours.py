"""Nearest target point of every source point, exact, for clouds of any size, density and distance.

A small target is sent to the tasks, which look into a tree of its points. A larger one is dealt
out by ranges of a space-filling code, a tree each, and a directory of the ranges' boxes is sent
instead. A source point first asks the range whose box is nearest; then only those whose boxes
are nearer than what it has found. No pair of points ever becomes a row.

Points that aren't finite take no part, on either side. The nearest is that of the least squared
distance, ties to the least target_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudframe.operators.points import validate_points
from cloudframe.operators.spatial import Boxes, Tree
from cloudframe.operators.tables import discard, written

#: A target of so many points at most (24 bytes each) is sent whole to the tasks.
BROADCAST_TARGET = 200_000
#: Points of a range, and ranges at most: beyond, ranges are larger.
RANGE, RANGES = 100_000, 200_000
FOUND = T.StructType([T.StructField("target_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("tx", "ty", "tz", "distance"))])


def nearest_any(source: DataFrame, target: DataFrame, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """source with target_id, tx, ty, tz, distance of each point's nearest target, whatever the distance. `keys` name a source point."""
    return nearest(source, target, None, keys)


def nearest_within(source: DataFrame, target: DataFrame, threshold: float, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """As nearest_any(), for the source points that have a target at most `threshold` away; the others are left out."""
    return nearest(source, target, threshold, keys)


def nearest(source: DataFrame, target: DataFrame, threshold: float | None, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    source, target = validate_points(source), validate_points(target)
    sent = send_target(target)
    return nearest_by_kernel(source, sent, threshold) if sent is not None else nearest_by_ranges(source, TargetRanges(target), threshold)


def send_target(target: DataFrame):
    """Broadcast the ids and places of a target's finite points, in order of id; None if it has more than BROADCAST_TARGET points."""
    target = validate_points(target)
    if target.limit(BROADCAST_TARGET + 1).count() > BROADCAST_TARGET:
        return None
    points = target.select("point_id", "x", "y", "z").toPandas().sort_values("point_id")
    return target.sparkSession.sparkContext.broadcast((points["point_id"].to_numpy(), np.ascontiguousarray(points[["x", "y", "z"]].to_numpy())))


def bound_of(threshold: float | None) -> float:
    """A squared distance that no target within the threshold exceeds."""
    return np.inf if threshold is None else threshold * threshold * (1 + 1e-12)


def nearest_by_kernel(source: DataFrame, sent, threshold: float | None = None, transforms: dict[object, np.ndarray] | None = None) -> DataFrame:
    """As nearest_any() against a target of send_target(), by an Arrow kernel.

    With a threshold, points without a target so near are left out. With transforms (4x4, by
    source_id) the points are moved first, and come out moved.
    """
    source = validate_points(source)
    schema = T.StructType([*source.schema.fields, *FOUND.fields])
    names = source.columns
    sources = pa.array(list(transforms)) if transforms else None
    matrices = np.stack(list(transforms.values())) if transforms else None

    def search(batches):
        ids, places = sent.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            columns = dict(zip(names, batch.columns, strict=True))
            p = np.stack([columns[c].to_numpy() for c in "xyz"], axis=1).astype(float)
            if transforms:
                m = matrices[pc.index_in(columns["source_id"], sources).to_numpy()]
                p = np.einsum("nij,nj->ni", m[:, :3, :3], p) + m[:, :3, 3]
                columns |= {c: pa.array(p[:, k].copy()) for k, c in enumerate("xyz")}
            row, square = cached_tree(places).nearest(p, np.full(len(p), bound_of(threshold)))
            near = (row >= 0) & ((threshold is None) | (np.sqrt(square) <= (threshold or 0.0)))
            extra = [ids[row[near]], *places[row[near]].T, np.sqrt(square[near])]
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(near)) for c in columns.values()), *(pa.array(np.ascontiguousarray(x)) for x in extra)], schema.names)

    return source.mapInArrow(search, schema)


#: The last target of a Python worker and its tree: a registration asks the same one in every round.
_last: tuple = (None, None)


def cached_tree(targets: np.ndarray) -> Tree:
    global _last
    if _last[0] is not targets:
        _last = (targets, Tree(targets))
    return _last[1]


def morton(low: list[float], width: float) -> Column:
    """Where a point lies on a space-filling curve: the bits of its three cells in turn, 20 each."""
    out = F.lit(0).cast("bigint")
    for k, c in enumerate("xyz"):
        cell = F.least(F.greatest(F.floor((F.col(c) - low[k]) / width * (1 << 20)), F.lit(0)), F.lit((1 << 20) - 1)).cast("bigint")
        # The masks that spread the bits of a number to every third place.
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(cell, k))
    return out


class TargetRanges:
    """A large target in ranges of the curve: a table of range, point_id, x, y, z, and the directory of their boxes, sent to the tasks.

    Points of one place are dealt out by id. The directory has 48 bytes a range, and at most
    RANGES ranges. The table stays until release().
    """

    def __init__(self, target: DataFrame) -> None:
        spark = target.sparkSession
        target = validate_points(target).select("point_id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
        n, *box = target.agg(F.count("*"), *(F.min(c) for c in "xyz"), *(F.max(c) for c in "xyz")).first()
        if not n:
            box = [0.0] * 6
        width = max(*(b / 2 - a / 2 for a, b in zip(box[:3], box[3:], strict=True)), 1e-300) * 2
        parts = max(1, -(-n // max(RANGE, -(-n // RANGES))))
        dealt = target.withColumn("code", morton(box[:3], width)).repartitionByRange(parts, "code", "point_id")
        self.table = written(dealt.select(F.spark_partition_id().alias("range"), "point_id", "x", "y", "z"))
        rows = self.table.groupBy("range").agg(*(f(c) for f in (F.min, F.max) for c in "xyz")).orderBy("range").collect()
        self.numbers = np.array([r[0] for r in rows], np.int64)
        corners = np.array([list(r)[1:] for r in rows], float).reshape(-1, 6)
        self.directory = spark.sparkContext.broadcast((corners[:, :3], corners[:, 3:]))

    def release(self) -> None:
        discard(self.table)
        self.directory.unpersist()


def nearest_by_ranges(source: DataFrame, ranges: TargetRanges, threshold: float | None = None) -> DataFrame:
    """As nearest_any() against a target in ranges. The points that ask are written twice, 100 bytes each, as each round reads them twice."""
    if not len(ranges.numbers):
        return source.where("false").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in FOUND))
    own = source.columns
    directory = ranges.directory

    def home(batches):
        low, high = directory.value
        boxes = Boxes(low, high)
        for batch in batches:
            p = np.stack([batch.column(own.index(c)).to_numpy() for c in "xyz"], axis=1).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes.descend(p))], [*own, "_leaf"])

    asking = validate_points(source).mapInArrow(home, T.StructType([*source.schema.fields, T.StructField("_leaf", T.LongType())]))
    asking = written(asking.withColumn("_row", F.monotonically_increasing_id()))
    places = asking.select("_row", "_leaf", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.lit(bound_of(threshold)).alias("_square"))
    first = written(_ask(places, ranges))

    def others(batches):
        low, high = directory.value
        boxes = Boxes(low, high)
        for batch in batches:
            row, leaf, x, y, z, square = (batch.column(k).to_numpy() for k in range(6))
            p = np.stack([x, y, z], axis=1).astype(float)
            for rows, leaves in boxes.within(p, square):
                other = leaves != leaf[rows]
                rows, leaves = rows[other], leaves[other]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (row[rows], leaves, *np.ascontiguousarray(p[rows].T), square[rows])], ["_row", "_leaf", "x", "y", "z", "_square"])

    told = places.drop("_square").join(first.select("_row", F.col("_square")), "_row").select("_row", "_leaf", "x", "y", "z", "_square")
    again = written(told.mapInArrow(others, "_row bigint, _leaf bigint, x double, y double, z double, _square double"))
    second = _ask(again, ranges)
    best = first.unionByName(second).where("target_id IS NOT NULL").groupBy("_row").agg(F.min(F.struct("_square", "target_id", "tx", "ty", "tz")).alias("_best"))
    out = asking.join(best, "_row").select(*own, "_best.target_id", "_best.tx", "_best.ty", "_best.tz", F.sqrt("_best._square").alias("distance"))
    return out if threshold is None else out.where(F.col("distance") <= threshold)


def _ask(places: DataFrame, ranges: TargetRanges) -> DataFrame:
    """_row, _square, target_id, tx, ty, tz: of each asking point the nearest target of its range, null if none is within its _square.

    A range that many ask is copied, so that a task has about RANGE points of either side.
    """
    numbers = [int(k) for k in ranges.numbers]
    asked = places.groupBy("_leaf").count()
    shares = asked.select("_leaf", F.ceil(F.col("count") / RANGE).cast("int").alias("_shares"))
    placed = places.join(F.broadcast(shares), "_leaf")  # a row a range
    left = placed.select(*places.columns, F.pmod(F.xxhash64("_row"), F.col("_shares")).cast("int").alias("_share"))
    index = places.sparkSession.createDataFrame(pa.table({"range": pa.array(numbers, pa.int32()), "_leaf": pa.array(range(len(numbers)), pa.int64())}))
    copies = shares.join(F.broadcast(index), "_leaf").select("range", F.col("_leaf").alias("_at"), F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
    right = ranges.table.join(copies, "range").select("_at", F.col("_share").alias("_to"), "point_id", *(F.col(c).alias(f"t{c}") for c in "xyz"))
    schema = "_row bigint, _square double, target_id bigint, tx double, ty double, tz double"

    def search(asking: pa.Table, there: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in schema.split(", ")]
        if not asking.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 3)], names)
        there = there.sort_by("point_id")
        p, t = (np.stack([table[f"{side}{c}"].to_numpy() for c in "xyz"], axis=1) for side, table in (("", asking), ("t", there)))
        row, square = Tree(t).nearest(p, asking["_square"].to_numpy())
        none = pa.array(row < 0)
        found = [pc.if_else(none, None, pa.array(x)) for x in (there["point_id"].to_numpy()[row], *np.ascontiguousarray(t[row].T))]
        return pa.table([asking["_row"], pa.array(square), *found], names)

    return left.groupBy("_leaf", "_share").cogroup(right.groupBy("_at", "_to")).applyInArrow(search, schema)
