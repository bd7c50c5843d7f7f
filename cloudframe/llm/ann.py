"""Approximate nearest neighbours by inner product, by counting collisions in query-centred windows.

Vectors get one more component so that all are equally long; then the largest inner product is
the least distance (Euclid). Each of m random directions gives every vector a projection, and
each block of vectors keeps them as m sorted arrays. A query puts a window around its own
projection in each array; a vector collides where it lies within. The windows grow by a factor
(virtual rehashing: nothing is hashed anew), until enough vectors collide in at least a share
of the arrays. Those are verified by exact inner products on the original vectors.

Vectors are shuffled once, to groups of bounded bytes. The queries are a table in the shared
folder; the task of a group indexes its vectors a block at a time and reads the queries' files in
turn, some at a time, returning the best k for each. Nothing passes the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm.shared import bound_arrow_batches, materialize

#: Vectors indexed together, bytes of the vectors that one task gets, and queries that it reads at once.
BLOCK, GROUP_BYTES, QUERIES = 8_192, 32 << 20, 32


@dataclass(frozen=True)
class Collisions:
    """directions: sorted arrays. share: of them in which a vector must collide. growth: of the
    windows from round to round; start: half the first window, in units of the vectors' length.
    A query's windows stop growing when `verify` of a block's vectors, and at least `least`,
    have collided often enough; if `rounds` windows don't suffice, all vectors are verified."""

    directions: int = 192
    share: float = 0.85
    start: float = 0.8
    growth: float = 1.1
    rounds: int = 20
    verify: float = 0.08
    least: int = 128
    seed: int = 5


def directions(dim: int, settings: Collisions) -> np.ndarray:
    return np.random.default_rng(settings.seed).standard_normal((dim + 1, settings.directions))


class Block:
    """The sorted arrays of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, lines: np.ndarray, settings: Collisions) -> None:
        self.ids, self.vectors, self.settings, self.longest = ids, vectors, settings, longest
        rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
        projected = (vectors @ lines[:-1] + rest[:, None] * lines[-1]).T.astype(np.float32)
        self.order = np.argsort(projected, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

        self.round = settings.rounds // 2

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where the windows begin and end, each queries x rounds x directions, for queries projected to `at`."""
        s = self.settings
        halves = (self.longest * s.start * s.growth ** np.arange(s.rounds)).astype(np.float32)
        at = at.astype(np.float32)
        begin, end = (np.stack([row.searchsorted(x[:, None] + sign * halves, side) for row, x in zip(self.sorted, at.T, strict=True)], axis=2) for sign, side in ((-1, "left"), (1, "right")))
        return begin, end

    def candidates(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Positions of the vectors that collide often enough with one query, whose windows are rounds x directions.

        The least round that finds enough is looked for from where the last query's was, and
        from round to round only what enters or leaves the windows is counted. Misses are
        counted, not collisions: wide windows leave out fewer vectors than they hold.
        """
        s, n = self.settings, len(self.ids)
        enough = min(n, max(s.least, int(np.ceil(s.verify * n))))
        allowed = int(s.directions * (1 - s.share))

        def count(parts: list[np.ndarray]) -> np.ndarray:
            return np.bincount(np.concatenate(parts), minlength=n)

        def between(less: int, more: int) -> np.ndarray:
            return count([row[i:j] for row, i, j in zip(self.order, begin[more], begin[less], strict=True)] + [row[i:j] for row, i, j in zip(self.order, end[less], end[more], strict=True)])

        at = self.round
        missed = count([row[:i] for row, i in zip(self.order, begin[at], strict=True)] + [row[i:] for row, i in zip(self.order, end[at], strict=True)])
        found = np.flatnonzero(missed <= allowed)
        if len(found) >= enough:
            while at:
                missed += between(at - 1, at)
                fewer = np.flatnonzero(missed <= allowed)
                if len(fewer) < enough:
                    break
                at, found = at - 1, fewer
        else:
            while len(found) < enough:
                at += 1
                if at == s.rounds:
                    at, found = at - 1, np.arange(n)
                    break
                missed -= between(at - 1, at)
                found = np.flatnonzero(missed <= allowed)
        self.round = at
        return found


def best(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, found: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """ids and inner products of the k best of the candidates found, ties to the smaller id.

    A fast product finds those near the cut, whatever its rounding; their scores are summed
    in one order, so equal vectors have equal scores.
    """
    found = found[ids[found] != query_id]
    scores = vectors[found] @ query
    if len(scores) > k:
        error = 1e-12 * longest * np.sqrt(query @ query)
        found = found[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - error]
    scores = (vectors[found] * query).sum(axis=1)
    order = np.lexsort((ids[found], -scores))[:k]
    return ids[found[order]], scores[order]


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, settings: Collisions = Collisions(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k nearest found.

    Queries are the rows for which is_query holds, candidates all rows but those of the
    query's id; score is the inner product in double precision, ties go to the smaller id.
    Rows of a null id, and vectors that are null, zero, of another length than most or with
    null or non-finite components, take no part. An id is one query and never its own answer,
    however many rows have it: of repeated query ids the least vector asks, and all of them
    are left out of its candidates.
    """
    bound_arrow_batches(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    rows = rows.where(usable(F.col("v"), dim))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = rows.agg(F.count("*"), F.coalesce(F.sqrt(F.max(square)), F.lit(0.0))).first()
    most = max(BLOCK, GROUP_BYTES // (8 * max(1, dim)))
    each = min(most, max(BLOCK, n // (2 * vectors.sparkSession.sparkContext.defaultParallelism)))
    placed = rows.select("id", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, -(-n // each)))).cast("int").alias("vector_group"))
    asking = materialize(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")))
    found = placed.groupBy("vector_group").applyInArrow(_search(directions(dim, settings), longest, settings, dim, k, asking._shared_path), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def arrays(table: pa.Table | pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("v")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return table.column("id").to_numpy(), vectors.flatten().to_numpy().reshape(-1, dim)


def queries_of(path: str, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries in the table at path, QUERIES at a time."""
    store, folder = fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))
    for file in sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as f:
            for batch in pq.ParquetFile(f).iter_batches(QUERIES, columns=["id", "v"]):
                if batch.num_rows:
                    yield arrays(batch, dim)


def _search(lines: np.ndarray, longest: float, settings: Collisions, dim: int, k: int, asking: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = arrays(pa.Table.from_batches(batches), dim)
        starts = range(0, len(ids), BLOCK)
        blocks = [Block(ids[s : s + BLOCK], vectors[s : s + BLOCK], longest, lines, settings) for s in starts]
        for query_ids, queries in queries_of(asking, dim):
            windows = [block.windows(queries @ lines[:-1]) for block in blocks]
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for row, query_id in enumerate(query_ids):
                found = np.concatenate([s + block.candidates(begin[row], end[row]) for s, block, (begin, end) in zip(starts, blocks, windows, strict=True)])
                near, scores = best(ids, vectors, query_id, queries[row], found, k, longest)
                out.append((np.full(len(near), query_id), near, scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return search
