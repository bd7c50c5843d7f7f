"""4x4 transforms: small matrices on the driver, their use on columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of a transform's twelve numbers in a table of cameras or poses.
NAMES = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


def make_transform(rotation: np.ndarray, translation: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rotation, translation
    return out


def inverse_rigid(transform: np.ndarray) -> np.ndarray:
    """Inverse of a rotation with translation."""
    rotation = transform[:3, :3].T
    return make_transform(rotation, -rotation @ transform[:3, 3])


def euler_matrix(ax: float, ay: float, az: float) -> np.ndarray:
    """Rotation about x, then y, then z."""

    def about(axis: int, angle: float) -> np.ndarray:
        i, j = [k for k in range(3) if k != axis]
        out = np.eye(3)
        sine = np.sin(angle) * (-1 if axis == 1 else 1)
        out[i, i] = out[j, j] = np.cos(angle)
        out[i, j], out[j, i] = -sine, sine
        return out

    return about(2, az) @ about(1, ay) @ about(0, ax)


def angle_of(rotation: np.ndarray) -> float:
    return float(np.arccos(np.clip((np.trace(rotation) - 1) / 2, -1, 1)))


def look_at(eye: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Camera to world with columns right, down, forward, for world's z up."""

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v)

    forward = unit(np.asarray(target, float) - eye)
    right = unit(np.cross(forward, [0.0, 0.0, 1.0]))
    return make_transform(np.stack([right, unit(np.cross(forward, right)), forward], axis=1), np.asarray(eye, float))


def numbers(transform: np.ndarray) -> list[float]:
    """The twelve numbers in the order of NAMES."""
    return [float(x) for x in (*transform[:3, :3].ravel(), *transform[:3, 3])]


def literals(transform: np.ndarray) -> list[Column]:
    return [F.lit(x) for x in numbers(transform)]


def applied(m: list[Column], x: Column, y: Column, z: Column) -> list[Column]:
    """rotation . p + translation for a transform of twelve columns."""
    return [m[3 * k] * x + m[3 * k + 1] * y + m[3 * k + 2] * z + m[9 + k] for k in range(3)]


def applied_inverse(m: list[Column], x: Column, y: Column, z: Column) -> list[Column]:
    """transposed rotation . (p - translation)."""
    dx, dy, dz = x - m[9], y - m[10], z - m[11]
    return [m[k] * dx + m[3 + k] * dy + m[6 + k] * dz for k in range(3)]
