"""Hard negatives by a two-dimensional block matrix product.

Vectors become integers. Anchors are dealt out to row blocks, all rows to column blocks, and the
components to chunks. A panel is one block's part of one chunk. Panels of anchors go along the
grid's rows and panels of rows along its columns: the task of (row block, column block, chunk)
multiplies two panels into a partial tile of int64 scores. Partial tiles are shuffled by
(row block, column block) and added up, and only a tile's first k of each list leave it.

It runs twice. First within labels, for each anchor's positives: blocks hold the rows of a bucket
of labels, so a tile holds few pairs of different labels. Then across labels, for the negatives in
the window that each positive's score opens. No pair of vectors becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm.shared import bound_arrow_batches, materialize

#: Anchors and rows of a block, components of a chunk, and buckets of labels.
ANCHORS, ROWS, CHUNK, BUCKETS = 256, 4096, 32, 64
#: What a component is multiplied by before it is cut to an integer.
SCALE = 256
#: The score of a pair that doesn't count; real ones are above half of it.
NONE = -(1 << 62)
#: Doubles hold integers up to here.
EXACT = 1 << 53

PARTIAL = "bucket int, i int, j int, anchor bigint, anchor_id bigint, windows binary, ids binary, scores binary"


def integers(rows: DataFrame, id_col: str, label_col: str, vector_col: str, label: Column) -> DataFrame:
    """row (a number of its own), id, label, v (array<bigint>) of the rows that take part.

    Rows of a null id or label, a null vector, a vector with null or non-finite components or of
    another length than most take no part. An empty vector has no component.
    """
    vector = F.col("v")
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)
    sizes = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    own = own.where(F.size("v") == (sizes["dim"] if sizes else 0))
    return own.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A score is the inner product of integers floor(SCALE x component) with the anchor's; higher
    ones come first, ties by the smaller id. An anchor's positives are its first other rows of
    the same label; for each the first rows of different labels are returned whose score is at
    least `low` percent of the positive's and at most as high. Every row stands for itself: rows of
    equal ids are different rows, and an anchor is never its own positive. Rows that take no part:
    integers(). Scores that 62 bits can't hold are an error.
    """
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    asks = F.coalesce(is_anchor, F.lit(False))
    rows = materialize(integers(vectors, id_col, label_col, vector_col, F.col(label_col) if label is None else label))
    named = rows.withColumnRenamed("id", id_col)
    n, dim, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dim, largest = dim or 0, int(largest or 0)
    if dim * largest * largest >= -NONE // 2:
        raise ValueError("components are too large for scores of 62 bits")
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    anchors = named.where(asks).withColumnRenamed(id_col, "id")
    counts = {r["bucket"]: r for r in named.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.count_if(asks).alias("anchors")).collect()}

    def blocks(key: str, size: int) -> Column:
        """The number of blocks in each bucket, for its rows or anchors."""
        return F.element_at(F.array(*(F.lit(max(1, -(-counts[b][key] // size)) if b in counts else 1) for b in range(BUCKETS))), bucket + 1)

    none = F.lit(None).cast("array<struct<place:int,id:bigint,score:bigint>>")
    left = _dealt(anchors.select(bucket.alias("bucket"), "row", "id", "label", "v", none.alias("windows")), blocks("anchors", ANCHORS), blocks("rows", ROWS), dim)
    right = _dealt(rows.select(bucket.alias("bucket"), "row", "id", "label", "v"), blocks("rows", ROWS), blocks("anchors", ANCHORS), dim)
    near = _tiles(left, right, largest, True, _first(positives), "anchor bigint, anchor_id bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    windows = materialize(near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("windows")))

    n_anchors = sum(c["anchors"] for c in counts.values())
    across = (F.lit(max(1, -(-n_anchors // ANCHORS))), F.lit(max(1, -(-n // ROWS))))
    asking = anchors.join(windows, F.col("row") == F.col("anchor"))
    left = _dealt(asking.select(F.lit(0).alias("bucket"), "row", "id", "label", "v", "windows"), *across, dim)
    right = _dealt(rows.select(F.lit(0).alias("bucket"), "row", "id", "label", "v"), *across[::-1], dim)
    found = _tiles(left, right, largest, False, _in_windows(negatives, low), "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _dealt(rows: DataFrame, own: Column, others: Column, dim: int) -> DataFrame:
    """Panels of the rows, each sent along the whole line of the other side's blocks: bucket, block, chunk, panel (a list of its rows), other."""
    chunks = max(1, -(-dim // CHUNK))
    placed = rows.select("*", F.pmod(F.xxhash64("row"), own).cast("int").alias("block"), others.alias("others"))
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("chunk"), F.slice("v", 1 + k * CHUNK, CHUNK).alias("part")) for k in range(chunks))))
    cut = placed.select("*", parts.alias("p")).drop("v").select("*", "p.chunk", "p.part").drop("p")
    return cut.select("*", F.explode(F.sequence(F.lit(0), F.col("others").cast("int") - 1)).alias("other")).drop("others")


def _tiles(left: DataFrame, right: DataFrame, largest: int, same: bool, reduce: Callable, schema: str) -> DataFrame:
    """Multiply panels, add partial tiles up, and reduce each tile to the rows that it may give to the result."""
    left = left.withColumnsRenamed({"block": "i", "other": "j"})
    right = right.select(*(F.col(c).alias({"block": "j", "other": "i"}.get(c, c)) for c in right.columns))  # columns of its own, as both sides come from one table
    keys = ("bucket", "i", "j", "chunk")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_product(largest, same), PARTIAL)
    return partial.groupBy("bucket", "i", "j").applyInArrow(_added(reduce, schema), schema)


def _panel(table: pa.Table, largest: int) -> np.ndarray:
    flat = table["part"].combine_chunks().flatten().to_numpy()
    exact = CHUNK * largest * largest < EXACT
    return flat.reshape(table.num_rows, -1).astype(np.float64 if exact else np.int64)


def _product(largest: int, same: bool):
    """Partial tiles, one row an anchor. The first chunk's carry what the reduction needs, and NONE where a pair doesn't count."""

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({f.split()[0]: pa.array([], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in PARTIAL.split(", ")})
        b = b.sort_by([("id", "ascending"), ("row", "ascending")])
        bucket, i, j, chunk = (a[c][0].as_py() for c in ("bucket", "i", "j", "chunk"))
        scores = (_panel(a, largest) @ _panel(b, largest).T).astype(np.int64)
        rows, ids, m = a["row"].to_numpy(), a["id"].to_numpy(), a.num_rows
        windows = row_ids = [None] * m
        if chunk == 0:
            equal = a["label"].to_numpy()[:, None] == b["label"].to_numpy()
            counts = equal & (rows[:, None] != b["row"].to_numpy()) if same else ~equal
            scores[~counts] = NONE
            row_ids = [b["id"].to_numpy().tobytes()] + row_ids[1:]
            if not same:
                windows = [np.array([(w["place"], w["id"], w["score"]) for w in ws], np.int64).tobytes() for ws in a["windows"].to_pylist()]
        columns = [np.full(m, x, np.int32) for x in (bucket, i, j)] + [rows, ids]
        lines = [line.tobytes() for line in scores]
        return pa.table([*map(pa.array, columns), pa.array(windows, pa.binary()), pa.array(row_ids, pa.binary()), pa.array(lines, pa.binary())], [f.split()[0] for f in PARTIAL.split(", ")])

    return product


def _added(reduce: Callable, schema: str):
    """Add the partial tiles of a group up, a batch at a time, and reduce their sum."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"int": pa.int32(), "bigint": pa.int64()}[f.split()[1]] for f in schema.split(", ")]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        about: dict[int, tuple] = {}
        row_ids = None
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("anchor", "anchor_id", "windows", "ids", "scores")}
            for k, anchor in enumerate(column["anchor"].to_pylist()):
                line = np.frombuffer(column["scores"][k].as_buffer(), np.int64)
                if anchor in sums:
                    sums[anchor] += line
                else:
                    sums[anchor] = line.copy()
                if column["windows"][k].is_valid:
                    about[anchor] = np.frombuffer(column["windows"][k].as_buffer(), np.int64).reshape(-1, 3)
                if column["ids"][k].is_valid:
                    row_ids = np.frombuffer(column["ids"][k].as_buffer(), np.int64).copy()
                about.setdefault(-1 - anchor, column["anchor_id"][k].as_py())
        found = [(anchor, about[-1 - anchor], *row) for anchor, line in sums.items() for row in reduce(line, row_ids, about.get(anchor))]
        columns = list(zip(*found, strict=True)) if found else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return added


def _descending(scores: np.ndarray, least: int) -> np.ndarray:
    """Positions of the scores from least on, highest first, ties in their order, which is that of the ids."""
    at = np.flatnonzero(scores >= least)
    return at[np.argsort(-scores[at], kind="stable")]


def _first(k: int) -> Callable:
    def reduce(scores: np.ndarray, ids: np.ndarray, _) -> list[tuple]:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else NONE
        return [(int(ids[p]), int(scores[p])) for p in _descending(scores, max(int(cut), NONE // 2))[:k]]

    return reduce


def _in_windows(k: int, low: int) -> Callable:
    def reduce(scores: np.ndarray, ids: np.ndarray, windows: np.ndarray) -> list[tuple]:
        out = []
        least = [-(-low * s // 100) for s in windows[:, 2].tolist()]
        order = _descending(scores, max(min(least), NONE // 2))
        falling = -scores[order]
        for (place, positive, score), floor in zip(windows.tolist(), least, strict=True):
            begin = int(np.searchsorted(falling, -score))
            for p in order[begin : begin + k]:
                if scores[p] < floor:
                    break
                out.append((place, positive, score, int(ids[p]), int(scores[p])))
        return out

    return reduce


#: As op11_hard_negatives, for DuckDB.
ORACLE_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 5
"""
