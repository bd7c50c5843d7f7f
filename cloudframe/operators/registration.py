"""Rigid registration: trimmed pairs, best-fit rotation, and the iterative loop over many sources at once."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudframe.functions.transforms import NAMES, applied, make_transform, numbers
from cloudframe.operators.neighbours import TargetRanges, nearest_by_kernel, nearest_by_ranges, send_target
from cloudframe.operators.order import TASK_ROWS, select_ranks
from cloudframe.operators.points import validate_points
from cloudframe.operators.tables import broadcast_if_few, discard, written
from cloudframe.schemas import DOUBLE, fields, local_table


def keep_near(pairs: DataFrame, threshold: float | None) -> DataFrame:
    """Pairs of at most the threshold; None or at most 0 keeps all."""
    return pairs if threshold is None or threshold <= 0 else pairs.where(F.col("distance") <= threshold)


#: Sources at most whose transforms, 128 bytes each, go to the tasks with the kernel; those of more are joined.
FEW_SOURCES = 10_000


def trim_pairs(pairs: DataFrame, trim: float, min_pairs: int, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Of each source's pairs those no farther than the k-th nearest, ties included; a source has any number of pairs.

    k = min(n, max(min_pairs, ceil(n x trim))); a trim of 1 keeps all. The k-th distance is
    selected by its bits, so that no source's pairs meet in one task, equal ones included; only a
    table of up to TASK_ROWS pairs is sorted instead. The distances are written as a table; pairs
    are read three times.
    """
    _check(trim)
    if trim == 1:
        return pairs
    names = [f"_by{k}" for k in range(len(by))]
    if pairs.limit(TASK_ROWS + 1).count() <= TASK_ROWS:
        return trim_few_pairs(pairs, trim, min_pairs, by)
    distances = written(pairs.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.col("distance").alias("value")))
    ranks = distances.groupBy(*names).agg(_rank(F.count("*"), trim, min_pairs).alias("k")).select(*names, F.lit("k").alias("tag"), (F.col("k") - 1).alias("rank"))
    cutoffs = broadcast_if_few(select_ranks(distances, ranks, names).withColumnRenamed("value", "_cutoff").drop("tag"))
    same = reduce(operator.and_, (F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)))
    return pairs.join(cutoffs, same).where(F.col("distance") <= F.col("_cutoff")).select(*pairs.columns)


def trim_few_pairs(pairs: DataFrame, trim: float, min_pairs: int, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """As trim_pairs(), in one pass over pairs of which a source has few enough to be sorted in one task."""
    _check(trim)
    if trim == 1:
        return pairs
    source = "PARTITION BY " + ", ".join(by)
    k = f"least(count(*) OVER ({source}), greatest({min_pairs}L, ceil(count(*) OVER ({source}) * {float(trim)!r}D)))"
    ranked = pairs.selectExpr("*", f"row_number() OVER ({source} ORDER BY distance) AS _rank", f"{k} AS _k")
    cut = ranked.selectExpr("*", f"max(CASE WHEN _rank = _k THEN distance END) OVER ({source}) AS _cutoff")
    return cut.where("distance <= _cutoff").drop("_rank", "_k", "_cutoff")


def _check(trim: float) -> None:
    if not 0 < trim <= 1:
        raise ValueError("trim must be above 0 and at most 1")


def _rank(n: Column, trim: float, min_pairs: int) -> Column:
    return F.least(n, F.greatest(F.lit(min_pairs), F.ceil(n * F.lit(trim))))


def pair_statistics(pairs: DataFrame, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """pair_count, mean_error and rmse of each source's pairs."""
    return pairs.groupBy(*by).agg(F.count("*").alias("pair_count"), F.avg("distance").alias("mean_error"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rmse"))


def pair_moments(pairs: DataFrame, origin: tuple[float, float, float], by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Statistics, and sums of both sides' places and of their nine products about an origin near the clouds.

    About a far origin the products' sums would drown the covariance in rounding.
    """
    p, q = ({c: f"({side}{c} - ({float(o)!r}D))" for c, o in zip("xyz", origin, strict=True)} for side in ("", "t"))
    sums = [f"sum({v}) AS {side}{c}" for side, place in (("p", p), ("q", q)) for c, v in place.items()]
    products = [f"sum({p[a]} * {q[b]}) AS s{a}{b}" for a in "xyz" for b in "xyz"]
    errors = ["count(*) AS pair_count", "avg(distance) AS mean_error", "sqrt(avg(distance * distance)) AS rmse"]
    return pairs.groupBy(*by).agg(*map(F.expr, [*errors, *sums, *products]))


def cross_covariance(pairs: DataFrame, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """pair_count, both centroids (p*, q*) and the nine sums of centred products (h**), in two passes."""
    centres = pairs.groupBy(*by).agg(F.count("*").alias("pair_count"), *(F.avg(c).alias(f"p{c}") for c in "xyz"), *(F.avg(f"t{c}").alias(f"q{c}") for c in "xyz"))
    joined = pairs.join(centres, list(by))
    products = [F.sum((F.col(a) - F.col(f"p{a}")) * (F.col(f"t{b}") - F.col(f"q{b}"))).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"]
    return centres.join(joined.groupBy(*by).agg(*products), list(by))


def best_fit(n: int, p: np.ndarray, q: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """4x4 transform that moves points of centroid p onto those of centroid q with the least squares.

    covariance has the sums of centred products, source by row. A reflection is undone.
    """
    if n < 3:
        raise ValueError("a fit needs at least three pairs")
    u, _, vt = np.linalg.svd(covariance)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    rotation = vt.T @ flip @ u.T
    return make_transform(rotation, q - rotation @ p)


def fit_row(row, origin: np.ndarray) -> np.ndarray:
    """best_fit() for a row of pair_moments()."""
    n = row["pair_count"]
    p, q = (np.array([row[f"{side}{c}"] for c in "xyz"]) / n for side in "pq")
    products = np.array([[row[f"s{a}{b}"] for b in "xyz"] for a in "xyz"])
    return best_fit(n, p + origin, q + origin, products - n * np.outer(p, q))


@dataclass
class Registered:
    """Outcome for one source; an infinite error means that no pair was left."""

    source_id: object
    transform: np.ndarray
    status: str = "max_iterations"
    iterations: int = 0
    mean_error: float = float("inf")
    rmse: float = float("inf")
    fitness: float = 0.0
    pair_count: int = 0
    history: list[dict] = field(default_factory=list)
    previous: float = float("inf")


def with_transforms(points: DataFrame, transforms: dict[object, np.ndarray], by: str = "source_id") -> DataFrame:
    """Move every source's points by its own transform. The transforms are a few numbers for each source."""
    schema = fields((by, points.schema[by].dataType), (" ".join(NAMES), DOUBLE))
    table = local_table(points.sparkSession, [(k, *numbers(m)) for k, m in transforms.items()], schema)
    joined = points.join(F.broadcast(table), by)
    x, y, z = applied([F.col(n) for n in NAMES], F.col("x"), F.col("y"), F.col("z"))
    return joined.withColumns({"_x": x, "_y": y, "_z": z}).select(*(F.col(f"_{c}").alias(c) if c in "xyz" and len(c) == 1 else F.col(c) for c in points.columns))


def register(sources: DataFrame, target: DataFrame, init: dict[object, np.ndarray] | None = None, max_iterations: int = 50, tolerance: float = 1e-6, threshold: float | None = None, trim: float = 0.9, min_pairs: int = 30) -> list[Registered]:
    """Register every source_id of `sources` with the target, all of them in the same jobs; both of any size.

    One job an iteration: pairs, trimming and moments on the executors, then a 3x3 problem
    for each source on the driver. Points are always moved from their original places, so
    the lineage doesn't grow. A source that has converged or lost its pairs leaves the loop.
    An iteration's fit is applied, and counted, before its error is compared with the last.
    A target that is too large to be sent to the tasks is asked range by range. The driver holds a
    row a source; for more than FEW_SOURCES take register_many().
    """
    _check(trim)
    tasks = sources.sparkSession.sparkContext.defaultParallelism
    sources = validate_points(sources).select("source_id", "point_id", "x", "y", "z")
    sources = (sources if sources.rdd.getNumPartitions() >= tasks else sources.repartition(tasks, "source_id", "point_id")).persist()
    target = validate_points(target).select("point_id", "x", "y", "z").persist()
    sent, ranges, near = None, None, threshold if threshold is not None and threshold > 0 else None
    try:
        totals = {r["source_id"]: r["n"] for r in sources.groupBy("source_id").agg(F.count("*").alias("n")).collect()}
        n_target, *middle = target.agg(F.count("*"), *(F.avg(c) for c in "xyz")).first()
        if n_target < min_pairs or not totals or min(totals.values()) < min_pairs:
            raise ValueError(f"source and target need at least {min_pairs} points")
        origin, sent = np.array(middle), send_target(target)
        ranges = TargetRanges(target) if sent is None else None
        out = {k: Registered(k, np.array((init or {}).get(k, np.eye(4)), float)) for k in totals}
        few = max(totals.values()) <= TASK_ROWS

        def neighbours(some: DataFrame, transforms: dict) -> DataFrame:
            if sent is not None and len(transforms) <= FEW_SOURCES:
                return nearest_by_kernel(some, sent, near, transforms)
            moved = with_transforms(some, transforms)
            if sent is not None:
                return nearest_by_kernel(moved, sent, near)
            return nearest_by_ranges(moved, ranges, near)

        def rows(ids: list, moments: bool) -> dict:
            some = sources if len(ids) == len(out) else sources.where(F.col("source_id").isin(ids))
            pairs = keep_near(neighbours(some, {k: out[k].transform for k in ids}), near)
            trimmed = trim_few_pairs(pairs, trim, min_pairs) if few else trim_pairs(pairs.persist(), trim, min_pairs)
            found = {r["source_id"]: r for r in (pair_moments(trimmed, tuple(origin)) if moments else pair_statistics(trimmed)).collect()}
            if not few:
                pairs.unpersist()
            return found

        left = list(out)
        for iteration in range(1, max_iterations + 1):
            found = rows(left, True)
            for k in list(left):
                item, row = out[k], found.get(k)
                if row is None or row["pair_count"] < min_pairs:
                    item.status = "not_enough_pairs"
                    left.remove(k)
                    continue
                item.history.append({"iteration": iteration, "pair_count": row["pair_count"], "mean_error": row["mean_error"], "rmse": row["rmse"]})
                item.transform = fit_row(row, origin) @ item.transform
                if abs(item.previous - row["mean_error"]) < tolerance:
                    item.status = "converged"
                    left.remove(k)
                item.previous = row["mean_error"]
            if not left:
                break
        for k, row in rows(list(out), False).items():
            out[k].mean_error, out[k].rmse, out[k].pair_count = row["mean_error"], row["rmse"], row["pair_count"]
            out[k].fitness = row["pair_count"] / max(1, totals[k])
        for item in out.values():
            item.iterations = len(item.history)
        return [out[k] for k in sorted(out, key=str)]
    finally:
        sources.unpersist()
        target.unpersist()
        if sent is not None:
            sent.unpersist()
        if ranges is not None:
            ranges.release()


FIT = T.StructType([*(T.StructField(n, T.DoubleType()) for n in NAMES), T.StructField("status", T.StringType()), T.StructField("previous", T.DoubleType())])
ROUND = "struct<iteration:int,pair_count:bigint,mean_error:double,rmse:double>"


def fit_batch(transforms: np.ndarray, moments: dict[str, np.ndarray], origin: np.ndarray) -> np.ndarray:
    """transforms (n x 4 x 4), each followed by the best fit of its moments, as fit_row() gives it; all of them in one call."""
    n = moments["pair_count"].astype(float)
    p, q = (np.stack([moments[f"{side}{c}"] for c in "xyz"], axis=1) / n[:, None] for side in "pq")
    products = np.stack([moments[f"s{a}{b}"] for a in "xyz" for b in "xyz"], axis=1).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(products - n[:, None, None] * p[:, :, None] * q[:, None, :])
    sign = np.sign(np.linalg.det(vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1)))
    flip = np.zeros_like(u)
    flip[:, 0, 0] = flip[:, 1, 1] = 1.0
    flip[:, 2, 2] = np.where(sign == 0, 1.0, sign)
    fit = np.tile(np.eye(4), (len(n), 1, 1))
    fit[:, :3, :3] = vt.transpose(0, 2, 1) @ flip @ u.transpose(0, 2, 1)
    fit[:, :3, 3] = q + origin - np.einsum("nij,nj->ni", fit[:, :3, :3], p + origin)
    return fit @ transforms


def register_many(sources: DataFrame, target: DataFrame, init: DataFrame | None = None, max_iterations: int = 50, tolerance: float = 1e-6, threshold: float | None = None, trim: float = 0.9, min_pairs: int = 30) -> DataFrame:
    """As register(), for any number of sources: a row a source with status, iterations, mean_error, rmse, fitness, pair_count, the transform (NAMES) and history.

    init: source_id and NAMES; a source without a row starts from where it is. What is known of
    the sources is a table that each round writes anew; their 3x3 problems are solved in the
    tasks, a batch at a time, and the driver sees how many are left. A source of fewer than
    min_pairs points has status too_few_points; only an unfit target is an error. Errors of a
    source without pairs are null.
    """
    _check(trim)
    near = threshold if threshold is not None and threshold > 0 else None
    points = written(validate_points(sources).select("source_id", "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    target = validate_points(target).select("point_id", "x", "y", "z")
    n_target, *middle = target.agg(F.count("*"), *(F.avg(c) for c in "xyz")).first()
    if n_target < min_pairs:
        raise ValueError(f"the target needs at least {min_pairs} points")
    sent, origin = send_target(target), np.array(middle)
    ranges = TargetRanges(target) if sent is None else None
    totals = points.groupBy("source_id").agg(F.count("*").alias("total"))
    few = (totals.agg(F.max("total")).first()[0] or 0) <= TASK_ROWS
    if init is None:
        init = totals.select("source_id", *(F.lit(x).alias(n) for n, x in zip(NAMES, numbers(np.eye(4)), strict=True))).where("false")
    start = {n: F.coalesce(F.col(n), F.lit(x)) for n, x in zip(NAMES, numbers(np.eye(4)), strict=True)}
    status = F.when(F.col("total") < min_pairs, "too_few_points").alias("status")
    begin = totals.join(init.select("source_id", *NAMES), "source_id", "left")
    state = written(begin.select("source_id", "total", *(c.alias(n) for n, c in start.items()), status, F.lit(float("inf")).alias("previous"), F.array().cast(f"array<{ROUND}>").alias("history")))

    def trimmed(some: DataFrame) -> DataFrame:
        joined = points.join(broadcast_if_few(some.select("source_id", *NAMES)), "source_id")
        x, y, z = applied([F.col(n) for n in NAMES], F.col("x"), F.col("y"), F.col("z"))
        moved = joined.select("source_id", "point_id", x.alias("x"), y.alias("y"), z.alias("z"))
        pairs = nearest_by_kernel(moved, sent, near) if sent is not None else nearest_by_ranges(moved, ranges, near)
        return trim_few_pairs(pairs, trim, min_pairs) if few else trim_pairs(written(pairs), trim, min_pairs)

    try:
        for iteration in range(1, max_iterations + 1):
            state = _round(state, trimmed, iteration, origin, tolerance, min_pairs)
            if not state.where("status IS NULL").limit(1).count():
                break
        last = pair_statistics(trimmed(state.where("status IS NULL OR status <> 'too_few_points'")))
        out = state.drop("previous").join(last, "source_id", "left").withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))
        return written(out.select("source_id", F.coalesce("status", F.lit("max_iterations")).alias("status"), F.size("history").alias("iterations"), "mean_error", "rmse", (F.col("pair_count") / F.col("total")).alias("fitness"), "pair_count", *NAMES, "history"))
    finally:
        discard(points, state)
        sent.unpersist() if sent is not None else ranges.release()


def _round(state: DataFrame, trimmed: Callable, iteration: int, origin: np.ndarray, tolerance: float, min_pairs: int) -> DataFrame:
    """The state after one more fit of the sources that have no status yet."""
    active = state.where("status IS NULL")
    fitted = active.join(pair_moments(trimmed(active), tuple(origin)), "source_id", "left")
    fitted = fitted.withColumn("_lost", F.coalesce(F.col("pair_count") < max(3, min_pairs), F.lit(True)))
    sums = [f"{side}{c}" for side in "pq" for c in "xyz"] + [f"s{a}{b}" for a in "xyz" for b in "xyz"]
    names = ["source_id", *NAMES, "previous", "pair_count", "mean_error", *sums]

    def fit(batches):
        for batch in batches:
            column = {n: batch.column(k).to_numpy() for k, n in enumerate(names) if n != "source_id"}
            before = np.tile(np.eye(4), (batch.num_rows, 1, 1))
            before[:, :3, :3] = np.stack([column[n] for n in NAMES[:9]], axis=1).reshape(-1, 3, 3)
            before[:, :3, 3] = np.stack([column[n] for n in NAMES[9:]], axis=1)
            after = fit_batch(before, column, origin)
            done = np.abs(column["previous"] - column["mean_error"]) < tolerance
            flat = [*after[:, :3, :3].reshape(-1, 9).T, *after[:, :3, 3].T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in flat), pa.array(np.where(done, "converged", None), pa.string()), pa.array(column["mean_error"])], ["source_id", *FIT.names])

    kept = written(fitted.select(*state.columns, "_lost", "pair_count", "mean_error", "rmse", *sums))
    new = kept.where(~F.col("_lost")).select(*names).mapInArrow(fit, T.StructType([state.schema["source_id"], *FIT.fields]))
    entry = F.struct(F.lit(iteration).alias("iteration"), "pair_count", "mean_error", "rmse").cast(ROUND)
    told = kept.where(~F.col("_lost")).select("source_id", "total", F.array_append("history", entry).alias("history")).join(new, "source_id")
    lost = kept.where("_lost").withColumn("status", F.lit("not_enough_pairs"))
    out = written(reduce(DataFrame.unionByName, (d.select(*state.columns) for d in (told, lost, state.where("status IS NOT NULL")))))
    discard(kept, state)
    return out


def report(spark, results: list[Registered]) -> DataFrame:
    """One row a source; infinite errors become null, as JSON has no infinity."""
    def number(x: float) -> float | None:
        return float(x) if np.isfinite(x) else None

    rows = [(str(r.source_id), r.status, r.iterations, number(r.mean_error), number(r.rmse), float(r.fitness), r.pair_count, [[float(x) for x in line] for line in r.transform], [(h["iteration"], h["pair_count"], h["mean_error"], h["rmse"]) for h in r.history]) for r in results]
    return spark.createDataFrame(rows, "source string, status string, iterations int, mean_error double, rmse double, fitness double, pair_count bigint, transform array<array<double>>, history array<struct<iteration:int,pair_count:bigint,mean_error:double,rmse:double>>")
