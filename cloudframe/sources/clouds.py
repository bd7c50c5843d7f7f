"""Point-cloud files through Spark's binaryFile reader: ply, npz, npy.

Spark lists and opens the files, so any file system it knows will do; each file is parsed by
one small function where it was read, and comes out as rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, cloud_id string, point_id bigint, x double, y double, z double, r smallint, g smallint, b smallint"

# Names of scalar types in PLY headers.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
# Arrays looked for in an NPZ file, in this order.
POINT_KEYS = ("points", "voxel_points", "raw_points", "tsdf_points", "observed_points")
COLOR_KEYS = ("colors", "voxel_colors", "raw_colors", "tsdf_colors", "observed_colors")

Cloud = tuple[np.ndarray, np.ndarray | None]


def ply_head(content: bytes) -> tuple[str, int, list[tuple[str, str]], int]:
    """Format, number of vertices, their fields (name, type) and the first byte after the header of a PLY file."""
    head, mark, _ = content.partition(b"end_header")
    if not head.startswith(b"ply") or not mark:
        raise ValueError("not a PLY file")
    kind, count, fields, element = "", None, [], ""
    for line in head.decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            element = words[1]
            if element == "vertex":
                count = int(words[2])
            elif count is None:
                raise ValueError(f"element {element} before the vertices")
        elif words[:1] == ["property"] and element == "vertex":
            if words[1] == "list":
                raise ValueError("list properties of vertices aren't supported")
            fields.append((words[2], "<" + PLY_TYPES[words[1]]))
    if count is None or not {"x", "y", "z"} <= {name for name, _ in fields}:
        raise ValueError("vertices need x, y and z")
    return kind, count, fields, content.index(b"\n", len(head)) + 1


def parse_ply(content: bytes) -> Cloud:
    """Points and colours of an ascii or binary little-endian PLY file.

    Elements after the vertices are ignored. Big-endian files, list properties of vertices
    and a number of rows other than the header's are errors.
    """
    kind, count, fields, begin = ply_head(content)
    body, names = content[begin:], [name for name, _ in fields]
    if kind == "ascii":
        lines = [line.split() for line in body.decode("ascii").splitlines() if line.strip()][:count]
        if len(lines) != count:
            raise ValueError(f"{len(lines)} rows of {count} vertices")
        values = np.array([line[: len(names)] for line in lines], dtype=np.float64).reshape(count, len(names))
        columns = dict(zip(names, values.T, strict=True))
    elif kind == "binary_little_endian":
        table = np.frombuffer(body, np.dtype(fields), count)
        columns = {name: table[name].astype(np.float64) for name in names}
    else:
        raise ValueError(f"PLY format {kind} isn't supported")
    rgb = next((c for c in (("red", "green", "blue"), ("r", "g", "b")) if set(c) <= set(names)), None)
    points = np.stack([columns[c] for c in "xyz"], axis=1)
    return points, np.stack([columns[c] for c in rgb], axis=1) if rgb else None


def _is_points(value: np.ndarray) -> bool:
    return value.ndim == 2 and value.shape[1] >= 3 and np.issubdtype(value.dtype, np.number)


def parse_npy(content: bytes) -> Cloud:
    value = np.load(io.BytesIO(content), allow_pickle=False)
    if not _is_points(value):
        raise ValueError("not an N x 3 array")
    return value[:, :3].astype(np.float64), None


def parse_npz(content: bytes, points_key: str | None = None) -> Cloud:
    """The array of points_key, or of the first known name, or else the first N x 3 one; colours by its name."""
    data = np.load(io.BytesIO(content), allow_pickle=False)
    wanted = [points_key] if points_key else POINT_KEYS
    key = next((k for k in wanted if k in data), None) or next((k for k in data.files if _is_points(data[k])), None)
    if key is None or not _is_points(data[key]):
        raise ValueError("no N x 3 array of points")
    points, colors = data[key][:, :3].astype(np.float64), None
    for name in (key.replace("points", "colors"), f"{key}_colors", *COLOR_KEYS):
        if name != key and name in data and data[name].ndim == 2 and data[name].shape[0] >= len(points) and data[name].shape[1] >= 3:
            colors = data[name][: len(points), :3]
            break
    return points, colors


def _reader(points_key: str | None) -> dict[str, Callable[[bytes], Cloud]]:
    return {"ply": parse_ply, "npz": lambda content: parse_npz(content, points_key), "npy": parse_npy}


def read_clouds(spark: SparkSession, paths: str | list[str], points_key: str | None = None) -> DataFrame:
    """SCHEMA rows of all files, each read whole (larger ones: store.read_cloud_files); the format goes by the suffix, another suffix is an error.

    cloud_id is the file's name without its suffix. Rows with a coordinate that isn't finite
    are dropped with their colours; point_id counts the file's rows.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = _reader(points_key)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stem, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
                if suffix.lower() not in readers:
                    raise ValueError(f"unsupported point-cloud format: {path}")
                points, colors = readers[suffix.lower()](content)
                good = np.isfinite(points).all(axis=1)
                rows = np.flatnonzero(good)
                rgb = [pa.nulls(len(rows), pa.int16())] * 3 if colors is None else [pa.array(np.clip(colors[rows, k], 0, 255).astype(np.int16)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([stem] * len(rows), pa.string()), pa.array(rows), *(pa.array(points[rows, k]) for k in range(3)), *rgb], ["path", "cloud_id", "point_id", "x", "y", "z", "r", "g", "b"])

    return files.mapInArrow(parse, SCHEMA)


def ply_lines(points: DataFrame, order: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """The body lines of an ascii PLY file, in order: eight decimals, then colours if there are any."""
    colored = {"r", "g", "b"} <= set(points.columns)
    template = "%.8f %.8f %.8f" + " %d %d %d" * colored
    return points.orderBy(*order).select(F.format_string(template, "x", "y", "z", *(("r", "g", "b") if colored else ())).alias("value"))


def write_ply(points: DataFrame, path: str, order: tuple[str, ...] = ("point_id",)) -> int:
    """Write one ascii PLY file; returns the number of points.

    Tasks make the text, in sorted ranges; the driver appends it a partition at a time. For
    clouds too large for one file, write ply_lines() or the points themselves in parts.
    """
    points = points.where("x is not null").persist()
    try:
        n, colored = points.count(), {"r", "g", "b"} <= set(points.columns)
        head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {c}" for c in "xyz")]
        head += [f"property uchar {c}" for c in ("red", "green", "blue")] * colored

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(batch.column(0).to_pylist())])], ["text"])

        with open(path, "w", encoding="ascii") as f:
            f.write("\n".join([*head, "end_header"]) + "\n")
            for row in ply_lines(points, order).mapInArrow(texts, "text string").toLocalIterator():
                f.write(row["text"] + "\n")
        return n
    finally:
        points.unpersist()


def npz_arrays(content: bytes) -> dict[str, np.ndarray]:
    """The arrays of an NPZ file that need no pickle; those that do are left out."""
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in archive.namelist():
            try:
                out[name.removesuffix(".npy")] = np.load(io.BytesIO(archive.read(name)), allow_pickle=False)
            except ValueError:
                continue
    return out
