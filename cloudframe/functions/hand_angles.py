"""Angles and landmarks of a hand of 21 joints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.vectors import at, bend, constant, cross, dot, minus, normalized

# Places of the landmarks as (cross, long, thick) fractions of the extents.
THUMB = [(0.52, 0.13, 0.0), (0.12, 0.34, 0.0), (0.04, 0.44, 0.04), (0.0, 0.56, 0.08), (-0.04, 0.68, 0.1)]
FINGER_ROWS = [(0.25, (0.55, 0.72, 0.86, 0.98)), (0.45, (0.57, 0.76, 0.90, 1.02)), (0.65, (0.55, 0.72, 0.86, 0.98)), (0.84, (0.52, 0.67, 0.80, 0.92))]
FRACTIONS = THUMB + [(across, along, 0.0) for across, places in FINGER_ROWS for along in places]


def with_palm_frame(hands: DataFrame, joints: str, prefix: str = "palm_") -> DataFrame:
    """Add the palm's axes as vectors {prefix}x, {prefix}y, {prefix}z.

    x runs from the index to the pinky knuckle, y about from the wrist to the middle one,
    z across both. Each is a column of its own, so that nothing is computed many times over.
    """
    x, y, z, up = (f"{prefix}{name}" for name in ("x", "y", "z", "up"))
    hands = hands.withColumns({x: normalized(minus(at(joints, 17), at(joints, 5)), constant(1, 0, 0)), up: normalized(minus(at(joints, 9), at(joints, 0)), constant(0, 1, 0))})
    hands = hands.withColumn(z, normalized(cross(F.col(x), F.col(up)), constant(0, 0, 1)))
    return hands.withColumn(y, normalized(cross(F.col(z), F.col(x)), F.col(up))).drop(up)


def abduction_and_flexion(v: Column, prefix: str = "palm_") -> Column:
    """A base joint's two angles in the palm's frame, as a struct."""
    x, y, z = (dot(F.col(f"{prefix}{name}"), v) for name in "xyz")
    return F.struct(F.atan2(x, y).alias("abduction"), F.atan2(F.abs(z), y).alias("flexion"))


def _indices(rows: list[tuple[int, ...]]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(map(str, row)) + ")" for row in rows) + ")")


def with_hand_angles(hands: DataFrame, joints: str = "joints_3d_left_m") -> DataFrame:
    """Add hand_angles_20dof_rad and hand_angles_20dof_deg, in the order of schemas.ANGLE_NAMES.

    The same expression serves every finger: it runs over a list of joint numbers.
    """
    roots = (1, 5, 9, 13, 17)
    point = lambda k: at(F.col(joints), k)
    bases = F.transform(_indices([(k, k + 1) for k in roots]), lambda t: abduction_and_flexion(minus(point(t[1]), point(t[0]))))
    bends = F.transform(_indices([(k + n, k + n + 1, k + n + 2) for k in roots for n in (0, 1)]), lambda t: bend(point(t[0]), point(t[1]), point(t[2])))
    framed = with_palm_frame(hands, joints).withColumns({"_bases": bases, "_bends": bends})
    order = [("flexion", "abduction")] + [("abduction", "flexion")] * 4
    angles = ", ".join(f"_bases[{k}].{first}, _bases[{k}].{second}, _bends[{2 * k}], _bends[{2 * k + 1}]" for k, (first, second) in enumerate(order))
    framed = framed.withColumn("hand_angles_20dof_rad", F.expr(f"array({angles})")).drop("_bases", "_bends", "palm_x", "palm_y", "palm_z")
    return framed.withColumn("hand_angles_20dof_deg", F.transform("hand_angles_20dof_rad", F.degrees))


def landmarks(low: list[Column], high: list[Column], centre: list[Column]) -> Column:
    """array<array<double>> of 21 joints from a cloud's box and centre.

    The axes are ranked by extent (at least 1e-6; equal ones by their number): the longest
    is the finger's, the second runs across the hand, the least is the thickness.
    """
    extent = [F.greatest(b - a, F.lit(1e-6)) for a, b in zip(low, high, strict=True)]
    ranked = F.array_sort(F.array(*(F.struct(e.alias("extent"), F.lit(k).alias("axis")) for k, e in enumerate(extent))))
    across, along = ranked[1]["axis"], ranked[2]["axis"]

    def joint(f: Column) -> Column:
        return F.array(*(
            F.when(across == k, low[k] + f[0] * extent[k]).when(along == k, low[k] + f[1] * extent[k]).otherwise(centre[k] + f[2] * extent[k])
            for k in range(3)
        ))

    fractions = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in FRACTIONS) + ")")
    return F.transform(fractions, joint)
