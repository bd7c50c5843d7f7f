"""Tracks of hands through the frames of a clip, and smoothing along them, for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloudframe.functions.vectors import array_distance
from cloudframe.operators.tables import broadcast_if_few, discard, written

#: The fields that are smoothed; each gets a column of its name and _smooth.
FIELDS = ("joints_3d_left_m", "wrist_pose_6d_left_m_rad", "hand_angles_20dof_rad", "hand_angles_20dof_deg")
#: Rows of a track that one task smooths in one go.
STRETCH = 10_000


def links(hands: DataFrame, gate: float, clip: str = "clip") -> DataFrame:
    """(before, after): row_ids of hands of one side in successive frames of a clip that are each other's nearest, at most `gate` apart.

    Ties go to the lesser row_id. Rows of a null side are a side of their own; without a finite
    root, or not ok, a row has no link. A frame holds a few hands, so the pairs are a few times the rows.
    """
    there = hands if "frame_status" not in hands.columns else hands.where("frame_status = 'ok'")
    rows = there.select(F.col(clip).alias("clip"), "frame_index", F.coalesce(F.col("hand_side").cast("bigint"), F.lit(-1)).alias("side"), "row_id", F.col("root_translation_m").alias("root"))
    rows = rows.where(F.coalesce(F.forall("root", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    after = rows.select("clip", "side", (F.col("frame_index") - 1).alias("frame_index"), F.col("row_id").alias("after"), F.col("root").alias("to"))
    pairs = rows.withColumnRenamed("row_id", "before").join(after, ["clip", "side", "frame_index"])
    near = pairs.select("before", "after", array_distance(F.col("root"), F.col("to")).alias("d")).where(F.col("d") <= gate)
    ahead = near.groupBy("before").agg(F.min(F.struct("d", "after")).alias("n")).select("before", "n.after")
    back = near.groupBy("after").agg(F.min(F.struct("d", "before")).alias("n")).select("after", "n.before")
    return ahead.join(back, ["before", "after"])


def with_tracks(hands: DataFrame, gate: float = 0.1, clip: str = "clip") -> DataFrame:
    """Add track_id, the row_id of the track's first hand, and track_at, how many frames after that one. row_id names a row.

    Each row points to the one before it; pointers are doubled until all have reached a first row, in
    as many rounds as the longest track has bits. A row without links is a track of its own.
    """
    found = links(hands, gate, clip)
    ids = hands.select("row_id")
    pointers = written(ids.join(found.select(F.col("after").alias("row_id"), F.col("before").alias("to")), "row_id", "left").select("row_id", F.coalesce("to", "row_id").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("steps")))
    while True:
        next_ones = pointers.select(F.col("row_id").alias("_at"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        doubled = written(pointers.join(next_ones, F.col("to") == F.col("_at")).select("row_id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_to") != F.col("to")).alias("moved")))
        discard(pointers)
        pointers, moved = doubled, doubled.where("moved").limit(1).count()
        if not moved:
            break
    return hands.join(pointers.select("row_id", F.col("to").alias("track_id"), F.col("steps").alias("track_at")), "row_id")


def _vector(hands: DataFrame, names: list[str]) -> Column:
    """The fields side by side as one array; null if one of them is."""
    parts = [F.flatten(n) if _nested(hands, n) else F.col(n) for n in names]
    whole = F.concat(*parts)
    return F.when(~F.exists(whole, lambda x: x.isNull() | F.isnan(x)), whole.cast("array<double>"))


def scan(values: np.ndarray, there: np.ndarray, alpha: float, start: np.ndarray) -> np.ndarray:
    """start, then each value by alpha and what came before by 1 - alpha; what isn't there changes nothing."""
    out, last = np.empty_like(values), start
    for k in range(len(values)):
        if there[k]:
            last = alpha * values[k] + (1 - alpha) * last
        out[k] = last
    return out


def smooth(tracked: DataFrame, alpha: float = 0.5, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Add `<field>_smooth`: a recursive filter along each track, whatever its length.

    The filter starts at the track's first row; a row without values (null or NaN), or whose
    frame_status isn't ok, keeps the value before it, and has none before the first. Long tracks
    are cut into stretches that are filtered by themselves from zero; what a stretch takes over from the one before
    fades by a power of 1 - alpha, so the stretches' ends are put together and added.
    """
    names = [n for n in fields if n in tracked.columns]
    ok = F.col("frame_status") == "ok" if "frame_status" in tracked.columns else F.lit(True)
    rows = tracked.select("row_id", "track_id", "track_at", F.floor(F.col("track_at") / STRETCH).alias("stretch"), F.when(ok, _vector(tracked, names)).alias("v"))
    schema = "row_id bigint, track_id bigint, stretch bigint, track_at bigint, own array<double>, fade double, first array<double>"

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("track_at")
        there = table["v"].is_valid().to_numpy()
        lists = table["v"].to_pylist()
        width = len(next((x for x in lists if x is not None), []))
        values = np.array([x if x is not None else [0.0] * width for x in lists]).reshape(len(lists), width)
        found = scan(values, there, alpha, np.zeros(width))
        fade = (1 - alpha) ** np.cumsum(there)
        first = values[there.argmax()].tolist() if there.any() else None
        return pa.table({"row_id": table["row_id"], "track_id": table["track_id"], "stretch": table["stretch"], "track_at": table["track_at"], "own": pa.array(list(found), pa.list_(pa.float64())), "fade": fade, "first": pa.array([first] * len(lists), pa.list_(pa.float64()))})

    parts = written(rows.groupBy("track_id", "stretch").applyInArrow(own, schema))
    ends = parts.groupBy("track_id", "stretch").agg(F.max_by(F.struct("own", "fade"), "track_at").alias("end"), F.first("first").alias("first"))

    def carried(table: pa.Table) -> pa.Table:
        """What each stretch takes over: at first the track's first value."""
        table = table.sort_by("stretch")
        carry, out = None, []
        for first, end in zip(table["first"].to_pylist(), table["end"].to_pylist(), strict=True):
            carry = np.array(first) if carry is None and first is not None else carry
            out.append(None if carry is None else carry.tolist())
            if first is not None:
                carry = np.array(end["own"]) + end["fade"] * carry
        return pa.table({"track_id": table["track_id"], "stretch": table["stretch"], "carry": pa.array(out, pa.list_(pa.float64()))})

    carries = ends.groupBy("track_id").applyInArrow(carried, "track_id bigint, stretch bigint, carry array<double>")
    # Before the first value of a track there is nothing: there the fade is 1 and nothing is the track's own.
    begun = F.col("fade") < 1 if alpha > 0 else F.lit(True)
    later = F.col("stretch") > F.col("begins")
    begins = ends.where("first IS NOT NULL").groupBy("track_id").agg(F.min("stretch").alias("begins"))
    joined = parts.join(carries, ["track_id", "stretch"]).join(broadcast_if_few(begins), "track_id", "left")
    value = F.when(begun | later, F.transform(F.arrays_zip(F.col("own").alias("o"), F.col("carry").alias("c")), lambda x: F.coalesce(x["o"], F.lit(0.0)) + F.col("fade") * x["c"]))
    return _named(tracked.join(joined.select("row_id", value.alias("_smooth")), "row_id"), tracked, names)


def _nested(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType.elementType, T.ArrayType)


def _named(rows: DataFrame, like: DataFrame, names: list[str]) -> DataFrame:
    """Cut the vector `_smooth` into columns shaped like the fields, whose sizes are those of the table."""
    sizes = [F.max(F.size(F.flatten(n) if _nested(like, n) else F.col(n))) for n in names] + [F.max(F.size(F.col(n)[0])) if _nested(like, n) else F.lit(1) for n in names]
    found = [max(1, k or 1) for k in like.agg(*(c.alias(f"_{k}") for k, c in enumerate(sizes))).first()]
    columns, at = {}, 1
    for n, width, inner in zip(names, found[: len(names)], found[len(names) :], strict=True):
        if _nested(like, n):
            part = F.array(*(F.slice("_smooth", k, inner) for k in range(at, at + width, inner)))
        else:
            part = F.slice("_smooth", at, width)
        columns[f"{n}_smooth"] = F.when(F.col("_smooth").isNotNull(), part)
        at += width
    return rows.withColumns(columns).drop("_smooth")


def smooth_stream(tracked: DataFrame, alpha: float = 0.5, field: str = "root_translation_m") -> DataFrame:
    """row_id, track_id, track_at, smooth of a stream of tracked rows: as smooth() gives it for the field, batch by batch.

    The state of a track is its last place and value. Rows of a batch are taken in order; one
    that comes after a later one of its track has been seen is dropped, as its successors are out.
    """
    schema = "row_id bigint, track_id bigint, track_at bigint, smooth array<double>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("track_at")
        last_at, last = (state.get[0], list(state.get[1]) or None) if state.exists else (-1, None)
        out = []
        for row in rows.itertuples():
            if row.track_at <= last_at:
                continue
            value = None if row.v is None else np.asarray(row.v, float)
            if value is not None and not np.isnan(value).any():
                last = value.tolist() if last is None else (alpha * value + (1 - alpha) * np.array(last)).tolist()
            last_at = row.track_at
            out.append((row.row_id, key[0], row.track_at, last))
        state.update((last_at, last or []))
        yield pd.DataFrame(out, columns=["row_id", "track_id", "track_at", "smooth"])

    rows = tracked.select("row_id", "track_id", "track_at", F.col(field).alias("v"))
    return rows.groupBy("track_id").applyInPandasWithState(step, schema, "last_at bigint, last array<double>", "append", GroupStateTimeout.NoTimeout)
