import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.functions.transforms import NAMES, angle_of, euler_matrix, inverse_rigid, look_at, make_transform, numbers
from cloudframe.operators import neighbours, points, registration, spatial


def cloud(spark, rows, extra=""):
    return spark.createDataFrame(rows, "point_id bigint, x double, y double, z double" + extra)


def test_non_finite_rows_go_with_their_colours(spark):
    nan, inf = float("nan"), float("inf")
    df = cloud(spark, [(0, 0.0, 0.0, 0.0, 1), (1, nan, 0.0, 0.0, 2), (2, 0.0, inf, 0.0, 3), (3, 0.0, 0.0, None, 4)], ", r int")
    assert [(r.point_id, r.r) for r in points.validate_points(df).collect()] == [(0, 1)]


def test_voxels_of_negative_places_and_truncated_colours(spark):
    df = cloud(spark, [(0, -0.01, 0.0, 0.0, 254), (1, -0.03, 0.0, 0.0, 255), (2, 0.01, 0.0, 0.0, 3)], ", r smallint")
    out = {r.kx: r for r in points.voxel_downsample(df, 0.05).collect()}
    assert sorted(out) == [-1, 0]
    assert out[-1].x == pytest.approx(-0.02) and out[-1].n == 2 and out[-1].r == 254


@pytest.mark.parametrize("size", [None, 0, -1.0])
def test_no_voxel_size_passes_through(spark, size):
    df = cloud(spark, [(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)])
    assert points.voxel_downsample(df, size).count() == 2


def test_empty_cloud(spark):
    df = cloud(spark, [])
    assert points.voxel_downsample(df, 0.1).count() == 0
    box = points.bounding_box(df).first()
    assert box.point_count == 0 and box.extent_x == 0.0


def test_mixed_label_voxel_counts_once_in_all(spark):
    df = cloud(spark, [(0, 0.01, 0.0, 0.0, 1), (1, 0.02, 0.0, 0.0, 2)], ", label int")
    got = {(r.label, r.all_labels): r.n for r in points.voxels_by_label(df, 0.1).collect()}
    assert got == {(None, 1): 2, (1, 0): 1, (2, 0): 1}


def test_sample_is_exact_and_repeatable(spark):
    df = cloud(spark, [(k, float(k), 0.0, 0.0) for k in range(50)])
    a, b = ({r.point_id for r in points.sample_points(df, 20).collect()} for _ in range(2))
    assert len(a) == 20 and a == b
    assert points.sample_points(df, 0).count() == points.sample_points(df, 50).count() == 50
    grouped = points.sample_points(df.withColumn("source_id", F.col("point_id") % 2), 5, by=("source_id",))
    assert {r.source_id: r["count"] for r in grouped.groupBy("source_id").count().collect()} == {0: 5, 1: 5}


def test_concat_keeps_colours_only_if_all_have_them(spark):
    plain, colored = cloud(spark, [(0, 0.0, 0.0, 0.0)]), cloud(spark, [(1, 0.0, 0.0, 0.0, 1, 2, 3)], ", r int, g int, b int")
    assert "r" not in points.concat_clouds([plain, colored]).columns
    assert "r" in points.concat_clouds([colored, colored]).columns


def brute(source, target):
    d = np.linalg.norm(source[:, None] - target[None], axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-1, 1, (200, 3)), rng.uniform(-1, 1, (300, 3))
    b[7] = b[3]  # a tie
    return a, b, *(cloud(spark, [(k, *map(float, p)) for k, p in enumerate(x)]) for x in (a, b))


def test_neighbours_agree_with_brute_force(spark, two):
    a, b, source, target = two
    index, distance = brute(a, b)
    for found in (neighbours.nearest_any(source, target), neighbours.nearest_by_kernel(source, neighbours.send_target(target))):
        rows = {r.point_id: (r.target_id, r.distance) for r in found.collect()}
        assert [rows[k][0] for k in range(len(a))] == index.tolist()
        assert np.allclose([rows[k][1] for k in range(len(a))], distance)
    near = {r.point_id: r.target_id for r in neighbours.nearest_within(source, target, 0.15).collect()}
    assert near == {k: i for k, (i, d) in enumerate(zip(index.tolist(), distance, strict=True)) if d <= 0.15}


def test_neighbours_of_an_empty_target(spark, two):
    empty = cloud(spark, [])
    assert neighbours.nearest_any(two[2], empty).count() == 0
    assert neighbours.nearest_within(two[2], empty, 1.0).count() == 0
    assert neighbours.nearest_by_kernel(two[2], neighbours.send_target(empty)).count() == 0


def test_trim_keeps_ties_and_at_least_min_pairs(spark):
    df = spark.createDataFrame([(0, d) for d in (1.0, 2.0, 2.0, 3.0)], "source_id int, distance double")
    assert registration.trim_pairs(df, 0.5, 1).count() == 3
    assert registration.trim_pairs(df, 0.1, 4).count() == 4
    assert registration.trim_pairs(df, 1.0, 1).count() == 4
    with pytest.raises(ValueError):
        registration.trim_pairs(df, 0.0, 1)


def test_best_fit_undoes_a_reflection_and_needs_three():
    rng = np.random.default_rng(0)
    flat = np.c_[rng.normal(size=(20, 2)), np.zeros(20)]
    m = make_transform(euler_matrix(0.3, -0.2, 1.0), np.array([1.0, 2.0, 3.0]))
    moved = flat @ m[:3, :3].T + m[:3, 3]
    p, q = flat.mean(0), moved.mean(0)
    fit = registration.best_fit(20, p, q, (flat - p).T @ (moved - q))
    assert np.linalg.det(fit[:3, :3]) == pytest.approx(1) and np.allclose(fit, m)
    with pytest.raises(ValueError):
        registration.best_fit(2, p, q, np.eye(3))


def test_registration_recovers_a_motion(spark):
    rng = np.random.default_rng(3)
    base = rng.uniform(-0.1, 0.1, (400, 3))
    m = make_transform(euler_matrix(0.02, -0.03, 0.01), np.array([0.002, -0.001, 0.003]))
    moved = base @ m[:3, :3].T + m[:3, 3]
    target = cloud(spark, [(k, *map(float, p)) for k, p in enumerate(base)])
    sources = cloud(spark, [(k, *map(float, p)) for k, p in enumerate(moved)]).withColumn("source_id", F.lit("a"))
    (got,) = registration.register(sources, target, max_iterations=40, tolerance=1e-9)
    assert got.status == "converged" and got.iterations == len(got.history)
    assert np.allclose(got.transform, inverse_rigid(m), atol=1e-6)
    assert got.fitness == pytest.approx(got.pair_count / 400)
    (lost,) = registration.register(sources.withColumn("x", F.col("x") + 9), target, threshold=0.01)
    assert lost.status == "not_enough_pairs" and lost.pair_count == 0 and np.isinf(lost.mean_error)
    assert registration.report(spark, [lost]).first().mean_error is None
    with pytest.raises(ValueError):
        registration.register(sources.limit(5), target)


def test_registration_of_many_sources_on_the_executors(spark, monkeypatch):
    """The same transforms, statuses and histories as by the driver's loop."""
    rng = np.random.default_rng(6)
    base = rng.uniform(-0.1, 0.1, (300, 3))
    target = cloud(spark, [(k, *map(float, p)) for k, p in enumerate(base)])
    rows = []
    for s in range(7):
        m = euler_matrix(*rng.uniform(-0.1, 0.1, 3))
        some = base[rng.permutation(300)[: 60 + 20 * s]]
        rows += [(s, k, *map(float, p)) for k, p in enumerate(some @ m.T + rng.uniform(-0.01, 0.01, 3) + rng.normal(0, 2e-4, some.shape))]
    rows += [(7, k, 50.0 + k, 0.0, 0.0) for k in range(60)] + [(5, 999, float("nan"), 0.0, 0.0)]  # far from all targets; not finite
    schema = "source_id int, point_id bigint, x double, y double, z double"
    sources, few = spark.createDataFrame(rows, schema), spark.createDataFrame([(8, 0, 0.0, 0.0, 0.0)], schema)
    init = {k: make_transform(euler_matrix(0.01 * k, 0, 0), np.zeros(3)) for k in (1, 2)}
    table = spark.createDataFrame([(k, *numbers(m)) for k, m in init.items()], "source_id int, " + ", ".join(f"{n} double" for n in NAMES))
    for most, rounds in ((10**6, 4), (50, 1)):
        monkeypatch.setattr(registration, "TASK_ROWS", 10**6)
        want = registration.register(sources, target, init, max_iterations=rounds, threshold=0.05, trim=0.8)
        monkeypatch.setattr(registration, "TASK_ROWS", most)
        got = {r.source_id: r for r in registration.register_many(sources.union(few), target, table, max_iterations=rounds, threshold=0.05, trim=0.8).collect()}
        assert sorted(got) == list(range(9)) and (got[8].status, got[8].iterations, got[8].mean_error) == ("too_few_points", 0, None)
        for w in want:
            g = got[w.source_id]
            assert (g.status, g.iterations, g.pair_count, g.fitness) == (w.status, w.iterations, w.pair_count, pytest.approx(w.fitness))
            assert np.allclose([g[n] for n in NAMES], numbers(w.transform), atol=1e-9)
            assert (g.mean_error, g.rmse) == (pytest.approx(w.mean_error), pytest.approx(w.rmse)) if w.pair_count else g.mean_error is None
            assert [(h.iteration, h.pair_count) for h in g.history] == [(h["iteration"], h["pair_count"]) for h in w.history]
    with pytest.raises(ValueError):
        registration.register_many(sources, target.limit(3))


def test_poses():
    m = look_at(np.array([0.6, 0.1, 0.5]), np.zeros(3))
    assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3)) and np.allclose(m[:3, 2], -np.array([0.6, 0.1, 0.5]) / np.linalg.norm([0.6, 0.1, 0.5]))
    assert angle_of(euler_matrix(0, 0, 0.25)) == pytest.approx(0.25)
    rz, ry, rx = euler_matrix(0, 0, 0.3), euler_matrix(0, 0.2, 0), euler_matrix(0.1, 0, 0)
    assert np.allclose(euler_matrix(0.1, 0.2, 0.3), rz @ ry @ rx)


def squares(points, targets):
    gap = points[:, None] - targets[None]
    return gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1] + gap[..., 2] * gap[..., 2]


SHAPES = {
    "even": lambda r: (r.uniform(-1, 1, (400, 3)), r.uniform(-1.3, 1.3, (300, 3))),
    "lattice": lambda r: (r.integers(0, 5, (600, 3)).astype(float), r.integers(-2, 14, (300, 3)) / 2),
    "one place": lambda r: (np.ones((500, 3)), r.uniform(-1, 1, (40, 3))),
    "two dense clouds": lambda r: (np.vstack([r.uniform(0, 1e-9, (300, 3)), r.uniform(1000, 1000.1, (300, 3))]), np.vstack([r.uniform(0, 1e-9, (150, 3)), r.uniform(-500, 2000, (150, 3))])),
    "a plane": lambda r: (r.uniform(0, 1, (500, 3)) * [1, 1, 0], r.uniform(0, 1, (200, 3))),
    "few": lambda r: (r.uniform(0, 1, (3, 3)), r.uniform(0, 1, (20, 3))),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_tree_agrees_with_brute_force(shape, monkeypatch):
    targets, asked = SHAPES[shape](np.random.default_rng(2))
    all_squares = squares(asked, targets)
    index, least = all_squares.argmin(axis=1), all_squares.min(axis=1)
    for leaf, pairs, asking in ((16, 1 << 20, 1 << 13), (2, 64, 50)):
        monkeypatch.setattr(spatial, "LEAF", leaf)
        monkeypatch.setattr(spatial, "PAIRS", pairs)
        monkeypatch.setattr(spatial, "ASKING", asking)
        row, square = spatial.Tree(targets).nearest(asked)
        assert row.tolist() == index.tolist() and square.tolist() == least.tolist()
        row, _ = spatial.Tree(targets).nearest(asked, np.full(len(asked), 0.04))
        assert row.tolist() == np.where(least <= 0.04, index, -1).tolist()


@pytest.mark.parametrize("shape", ["lattice", "one place", "two dense clouds"])
def test_targets_in_ranges(spark, shape, monkeypatch):
    """Far beyond the bound for sending the target: a few dozen ranges, asked by many."""
    targets, asked = SHAPES[shape](np.random.default_rng(3))
    odd = [[np.nan, 0, 0], [np.inf, 1, 1], [0, -np.inf, 0]]
    n, m = len(targets), len(asked)
    source, target = (cloud(spark, [(k, *map(float, p)) for k, p in enumerate([*x, *odd])]).repartition(3) for x in (asked, targets))
    all_squares = squares(asked, targets)
    index, least = all_squares.argmin(axis=1), all_squares.min(axis=1)
    for most, size in ((10_000, 10_000), (1, 20)):
        monkeypatch.setattr(neighbours, "BROADCAST_TARGET", most)
        monkeypatch.setattr(neighbours, "RANGE", size)
        got = {r.point_id: (r.target_id, r.distance, r.tx) for r in neighbours.nearest_any(source.withColumn("more", F.lit(1)), target).collect()}
        assert got == {k: (int(i), float(np.sqrt(d)), float(targets[i, 0])) for k, (i, d) in enumerate(zip(index, least, strict=True))}
        got = {r.point_id: r.target_id for r in neighbours.nearest_within(source, target, 0.2).collect()}
        assert got == {k: int(i) for k, (i, d) in enumerate(zip(index, least, strict=True)) if np.sqrt(d) <= 0.2}
        assert neighbours.nearest_any(source.where(f"point_id >= {m}"), target).count() == 0
        assert neighbours.nearest_any(source, target.where(f"point_id >= {n}")).count() == 0


def test_targets_too_large_to_be_sent(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_TARGET", 100)
    monkeypatch.setattr(neighbours, "RANGE", 60)
    rng = np.random.default_rng(3)
    base = rng.uniform(-0.1, 0.1, (400, 3))
    target = cloud(spark, [(k, *map(float, p)) for k, p in enumerate(base)])
    moved = target.withColumn("x", F.col("x") + 0.002).withColumn("source_id", F.lit("a"))
    for threshold in (0.03, None):
        (got,) = registration.register(moved, target, max_iterations=4, threshold=threshold)
        assert got.transform[0, 3] == pytest.approx(-0.002, abs=2e-4)


def test_trimming_by_selection_is_that_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(registration, "TASK_ROWS", 100)
    rng = np.random.default_rng(4)
    rows = [(int(s), float(d)) for s, d in zip(rng.integers(0, 3, 900), np.round(rng.exponential(1, 900), 2), strict=True)]
    df = spark.createDataFrame(rows, "source_id int, distance double")
    for trim, least in ((0.5, 1), (0.93, 30), (0.01, 250), (1.0, 1)):
        want = []
        for s in range(3):
            own = sorted(d for k, d in rows if k == s)
            cut = own[min(len(own), max(least, int(np.ceil(len(own) * trim)))) - 1]
            want += [(s, d) for d in own if d <= cut]
        assert sorted(map(tuple, registration.trim_pairs(df, trim, least).collect())) == sorted(want)
        assert sorted(map(tuple, registration.trim_few_pairs(df, trim, least).collect())) == sorted(want)


def test_exact_percentiles_and_ranges_of_any_size(spark, monkeypatch):
    from cloudframe.operators import order

    rng = np.random.default_rng(5)
    x, y = rng.exponential(1, 700), np.round(rng.normal(size=700), 1)
    df = spark.createDataFrame([(k, int(k % 2), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k bigint, side int, x double, y double").repartition(5)
    want = {"m": np.percentile(x, 50), "p": np.percentile(x, 95), "q": np.percentile(y, 5), "top": y.max()}
    for most in (10**6, 100):
        monkeypatch.setattr(order, "TASK_ROWS", most)
        monkeypatch.setattr(order, "DIGIT", 16 if most > 100 else 32)
        got = order.summary(df, [F.count("*").alias("n")], {"m": ("x", 0.5), "p": ("x", 0.95), "q": ("y", 0.05), "top": ("y", 1.0)}).first()
        assert got.n == 700 and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
        seen = order.with_previous(df, "x", "before", "side", "k").collect()
        assert {r.k: r.before for r in seen} == {k: x[k - 2] if k > 1 else None for k in range(700)}
        assert order.summary(df.limit(0), [F.count("*").alias("n")], {"m": ("x", 0.5)}).first().m is None


def test_selection_by_bits(spark):
    """Any doubles, mostly equal ones, groups of which one has no name."""
    from cloudframe.operators import order

    odd = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 0.5, 0.49999999999999994, 2.0, 1.9999999999999998, 8.0, 7.999999999999999, 1e-300, 3.0]
    rows = [(None if k % 3 == 0 else str(k % 3), v) for k, v in enumerate(odd * 3 + [0.25] * 200)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(3)
    bits = df.select("value", order.ordered_bits(F.col("value")).alias("b")).distinct().orderBy("b", "value").collect()
    assert [r.value for r in bits] == sorted(r.value for r in bits)
    distinct = {r.value: r.b for r in bits}
    assert len(set(distinct.values())) == len(distinct)
    groups = {g: sorted(v for h, v in rows if h == g) for g in (None, "1", "2")}
    ranks = [(g, f"t{k}", k) for g, values in groups.items() for k in range(0, len(values), 7)]
    got = order.select_ranks(df, spark.createDataFrame(ranks, "g string, tag string, rank bigint"), ["g"]).collect()
    assert {(r.g, r.tag): r.value for r in got} == {(g, t): groups[g][k] for g, t, k in ranks}


def test_previous_rows_of_null_groups(spark, monkeypatch):
    from cloudframe.operators import order

    rows = [(k, None if k % 5 == 0 else k % 2, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "k bigint, side int, x double").repartition(3)
    for most in (10**6, 40):
        monkeypatch.setattr(order, "TASK_ROWS", most)
        got = {r.k: r.before for r in order.with_previous(df, "x", "before", "side", "k").collect()}
        last, want = {}, {}
        for k, side, x in rows:
            want[k], last[side] = last.get(side), x
        assert got == want
