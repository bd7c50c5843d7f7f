"""Files by the tasks: data sources that read large clouds in parts and write many files in one job.

A write is all or nothing. Tasks write into a folder of the job's own; the driver moves the files
to their names once all tasks are done, and deletes the folder if one fails for good. Paths are
whatever pyarrow's file systems know: local and mounted folders, and the usual object stores.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cloudframe.operators.tables import broadcast_if_few
from cloudframe.sources import clouds

#: Bytes of a large file that one task reads, and that are read at once.
PART, READ = 64 << 20, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    task: str = ""
    names: list[str] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """Writes into a folder of the job; files of the same names are replaced, and with overwrite all others in the folder go."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.stage = options["path"], overwrite, f"_stage-{uuid.uuid4().hex}"

    def fill(self, store: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> list[str]:
        """Write the rows' files into the folder; returns their names."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        task = uuid.uuid4().hex
        return Written(task, self.fill(store, f"{folder}/{self.stage}/{task}", iterator))

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        names = [name for m in messages if m for name in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file were in several tasks")
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for found in store.get_file_info(fs.FileSelector(folder)):
                if found.base_name != self.stage:
                    (store.delete_dir if found.type == fs.FileType.Directory else store.delete_file)(found.path)
        for m in messages:
            for name in m.names if m else ():
                store.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
                store.move(f"{folder}/{self.stage}/{m.task}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/{self.stage}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.stage}")


class ContentWriter(StagedWriter):
    def fill(self, store, folder, batches):
        names = []
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write(content)
                names.append(name)
        return names


class Contents(DataSource):
    """A sink of rows (path within the folder, content): each row becomes a file."""

    @classmethod
    def name(cls) -> str:
        return "cloudframe_contents"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> ContentWriter:
        return ContentWriter(self.options, overwrite)


def write_contents(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Store each row (path, content) as the file `path` of the folder, by the tasks; overwrite drops what else is there."""
    rows.sparkSession.dataSource.register(Contents)
    rows.select("path", "content").write.format("cloudframe_contents").mode("overwrite" if overwrite else "append").save(folder)


class PlySink:
    """A binary PLY file, written as rows come."""

    def __init__(self, stream, n: int, colored: bool) -> None:
        self.stream, self.colored = stream, colored
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property double {c}" for c in "xyz")] + [f"property uchar {c}" for c in ("red", "green", "blue")] * colored
        stream.write("\n".join([*head, "end_header", ""]).encode())
        self.kind = np.dtype([(c, "<f8") for c in "xyz"] + [(c, "u1") for c in "rgb"] * colored)

    def add(self, points: np.ndarray, colors: np.ndarray | None) -> None:
        rows = np.zeros(len(points), self.kind)
        for k, c in enumerate("xyz"):
            rows[c] = points[:, k]
        for k, c in enumerate("rgb" if self.colored else ""):
            rows[c] = colors[:, k]
        self.stream.write(rows.tobytes())

    def close(self) -> None:
        self.stream.close()


def _npy_head(n: int, kind: str) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": (n, 3)})
    return out.getvalue()


class NpySink:
    """An N x 3 array, without colours."""

    def __init__(self, stream, n: int, colored: bool) -> None:
        self.stream = stream
        stream.write(_npy_head(n, "<f8"))

    def add(self, points: np.ndarray, colors: np.ndarray | None) -> None:
        self.stream.write(points.astype("<f8").tobytes())

    def close(self) -> None:
        self.stream.close()


class NpzSink:
    """points, streamed, and colors, three bytes a point, kept until the points are written."""

    def __init__(self, stream, n: int, colored: bool) -> None:
        self.stream, self.n, self.colors = stream, n, [] if colored else None
        self.archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.member = self.archive.open("points.npy", "w", force_zip64=True)
        self.member.write(_npy_head(n, "<f8"))

    def add(self, points: np.ndarray, colors: np.ndarray | None) -> None:
        self.member.write(points.astype("<f8").tobytes())
        if self.colors is not None:
            self.colors.append(colors.astype("u1").tobytes())

    def close(self) -> None:
        self.member.close()
        if self.colors is not None:
            with self.archive.open("colors.npy", "w", force_zip64=True) as member:
                member.write(_npy_head(self.n, "|u1"))
                for part in self.colors:
                    member.write(part)
        self.archive.close()
        self.stream.close()


SINKS = {"ply": PlySink, "npy": NpySink, "npz": NpzSink}


class CloudWriter(StagedWriter):
    """Rows of cloud_id, n (of the cloud's rows), x, y, z and perhaps r, g, b, cloud by cloud."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.kind = options.get("kind", "ply")
        if self.kind not in SINKS:
            raise ValueError(f"unsupported point-cloud format: {self.kind}")

    def fill(self, store, folder, batches):
        names, sink, last = [], None, None
        store.create_dir(folder, recursive=True)
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            ids = column["cloud_id"].to_pylist()
            starts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
            for begin, end in zip(starts, [*starts[1:], len(ids)], strict=True):
                colored = "r" in column and column["r"][begin].is_valid
                if sink is None or ids[begin] != last:
                    if sink:
                        sink.close()
                    last = ids[begin]
                    names.append(f"{last}.{self.kind}")
                    sink = SINKS[self.kind](store.open_output_stream(f"{folder}/{names[-1]}"), column["n"][begin].as_py(), colored)
                part = slice(begin, end)
                points = np.stack([column[c].to_numpy()[part] for c in "xyz"], axis=1)
                sink.add(points, np.stack([column[c].to_numpy(zero_copy_only=False)[part] for c in "rgb"], axis=1) if colored else None)
        if sink:
            sink.close()
        return names


@dataclass
class Part(InputPartition):
    """Some whole files, or rows begin to end of one large file whose rows start at byte `offset`."""

    files: list[str]
    rows: tuple[int, int] | None = None
    offset: int = 0
    kind: np.dtype | None = None


class CloudReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.path, self.key, self.names = options["path"], options.get("points_key"), names
        self.part = int(options.get("part", PART))

    def partitions(self) -> list[Part]:
        """Small files together, binary PLY and NPY files beyond the size of a part in parts of whole rows."""
        store, folder = opened(self.path)
        info = store.get_file_info(folder)
        found = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File and "/_" not in f.path[len(folder) :]), key=lambda f: f.path)
        out, size = [], self.part
        for f in found:
            shape = head_of(store, f.path) if f.size > self.part else None
            if shape:
                offset, kind, n = shape
                step = max(1, self.part // kind.itemsize)
                out += [Part([f.path], (at, min(n, at + step)), offset, kind) for at in range(0, n, step)]
                size = self.part
            elif size + f.size > self.part:
                out.append(Part([f.path]))
                size = f.size
            else:
                out[-1].files.append(f.path)
                size += f.size
        return out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for path in partition.files:
            with store.open_input_file(path) as f:
                if partition.rows is None:
                    stem, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
                    parse = clouds._reader(self.key).get(suffix.lower())
                    if parse is None:
                        raise ValueError(f"unsupported point-cloud format: {path}")
                    points, colors = parse(f.read())
                    yield self.batch(path, stem, np.arange(len(points)), points, colors)
                    continue
                kind, stem = partition.kind, path.rsplit("/", 1)[-1].rpartition(".")[0]
                step = max(1, READ // kind.itemsize)
                for at in range(*partition.rows, step):
                    n = min(step, partition.rows[1] - at)
                    rows = np.frombuffer(f.read_at(n * kind.itemsize, partition.offset + at * kind.itemsize), kind)
                    if len(rows) < n:
                        raise ValueError(f"{path} ends before its last row")
                    rgb = next((c for c in (("red", "green", "blue"), ("r", "g", "b")) if set(c) <= set(kind.names)), None)
                    yield self.batch(path, stem, at + np.arange(n), np.stack([rows[c].astype(float) for c in "xyz"], axis=1), np.stack([rows[c] for c in rgb], axis=1) if rgb else None)

    def batch(self, path: str, stem: str, ids: np.ndarray, points: np.ndarray, colors: np.ndarray | None) -> pa.RecordBatch:
        """The columns asked for, of the rows that are finite."""
        good = np.flatnonzero(np.isfinite(points).all(axis=1))
        make = {"path": lambda: pa.array([path] * len(good), pa.string()), "cloud_id": lambda: pa.array([stem] * len(good), pa.string()), "point_id": lambda: pa.array(ids[good])}
        make |= {c: lambda k=k: pa.array(points[good, k]) for k, c in enumerate("xyz")}
        make |= {c: lambda k=k: pa.nulls(len(good), pa.int16()) if colors is None else pa.array(np.clip(colors[good, k], 0, 255).astype(np.int16)) for k, c in enumerate("rgb")}
        return pa.RecordBatch.from_arrays([make[c]() for c in self.names], self.names)


def head_of(store: fs.FileSystem, path: str) -> tuple[int, np.dtype, int] | None:
    """(first row's byte, type of a row, rows) of a binary PLY or a plain NPY file; None for files that are read whole."""
    with store.open_input_file(path) as f:
        head = f.read(1 << 16)
        if path.lower().endswith(".npy"):
            stream = io.BytesIO(head)
            version = np.lib.format.read_magic(stream)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
            if fortran or len(shape) != 2 or shape[1] < 3 or kind.kind not in "iuf":
                return None
            return stream.tell(), np.dtype([(c, kind) for c in "xyz"] + [(f"more{k}", kind) for k in range(3, shape[1])]), shape[0]
        if path.lower().endswith(".ply"):
            form, n, fields, offset = clouds.ply_head(head)
            return (offset, np.dtype(fields), n) if form == "binary_little_endian" else None
    return None


class Clouds(DataSource):
    """PLY, NPZ and NPY files under a path. Options: points_key; part, the bytes of a large file that one task reads; kind, of the files written.

    A schema of fewer columns makes only those.
    """

    @classmethod
    def name(cls) -> str:
        return "cloudframe_clouds"

    def schema(self) -> str:
        return clouds.SCHEMA

    def reader(self, schema) -> CloudReader:
        return CloudReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> CloudWriter:
        return CloudWriter(self.options, overwrite)


def read_cloud_files(spark: SparkSession, path: str, columns: str | None = None, **options: str) -> DataFrame:
    """As clouds.read_clouds() for the files at or below a path; large binary files are read by many tasks."""
    spark.dataSource.register(Clouds)
    reader = spark.read.format("cloudframe_clouds").options(**options)
    return (reader.schema(columns) if columns else reader).load(path)


def write_cloud_files(points: DataFrame, folder: str, kind: str = "ply", overwrite: bool = False, order: tuple[str, ...] = ("point_id",)) -> None:
    """One file of a kind (ply, npy, npz) for each cloud_id, all in one job; a cloud's points in order.

    A cloud's file is written by one task, as its rows come, whatever their number.
    """
    points.sparkSession.dataSource.register(Clouds)
    points = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND cloud_id IS NOT NULL")
    counts = points.groupBy("cloud_id").agg(F.count("*").alias("n"))
    colored = [F.col(c).cast("smallint").alias(c) for c in "rgb" if c in points.columns]
    rows = points.drop("n").join(broadcast_if_few(counts), "cloud_id").repartition("cloud_id").sortWithinPartitions("cloud_id", *order)
    rows = rows.select("cloud_id", "n", *(F.col(c).cast("double").alias(c) for c in "xyz"), *colored)
    rows.write.format("cloudframe_clouds").option("kind", kind).mode("overwrite" if overwrite else "append").save(folder)
