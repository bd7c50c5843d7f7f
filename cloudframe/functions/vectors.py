"""Vector algebra on struct<x, y, z> columns, without UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INF), F.lit(False))


def rounded(c: Column | str, digits: int = 8) -> Column:
    """Rounded for reports; never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def round_vector(values: Column | str, digits: int = 8) -> Column:
    """Every component of an array rounded."""
    return F.transform(values, lambda x: F.round(x, digits) + F.lit(0.0))


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def constant(x: float, y: float, z: float) -> Column:
    return vector(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def at(points: Column | str, k: Column | int) -> Column:
    """The k-th [x, y, z] of an array of arrays as a vector."""
    p = F.col(points)[k] if isinstance(points, str) else points[k]
    return vector(p[0], p[1], p[2])


def minus(a: Column, b: Column) -> Column:
    return vector(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def normalized(a: Column, fallback: Column) -> Column:
    """a over its length; fallback where that is under 1e-12."""
    n = norm(a)
    return F.when(n < 1e-12, fallback).otherwise(vector(F.try_divide(a["x"], n), F.try_divide(a["y"], n), F.try_divide(a["z"], n)))


def clamped_acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def angle_between(a: Column, b: Column) -> Column:
    """Angle of two vectors; pi/2 if either is shorter than 1e-12."""
    la, lb = norm(a), norm(b)
    return clamped_acos(F.when(F.least(la, lb) < 1e-12, 0.0).otherwise(F.try_divide(dot(a, b), la * lb)))


def bend(a: Column, b: Column, c: Column) -> Column:
    """How far the joint b, between a and c, departs from straight."""
    return F.lit(math.pi) - angle_between(minus(a, b), minus(c, b))


def euler_rotation(ax: Column, ay: Column, az: Column) -> list[list[Column]]:
    """Rows of the rotation about x, then y, then z."""
    sx, cx, sy, cy, sz, cz = F.sin(ax), F.cos(ax), F.sin(ay), F.cos(ay), F.sin(az), F.cos(az)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def rotation_angle(rows: list[list[Column]]) -> Column:
    """Angle of a rotation matrix about its axis."""
    return clamped_acos((rows[0][0] + rows[1][1] + rows[2][2] - 1.0) / 2.0)


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
