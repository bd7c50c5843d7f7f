"""Sharding, mixing, PII and neighbour search against brute force."""

import hashlib
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.llm import ann, entry, mixing, pii, sharding

DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_lookup_table_is_the_permutations():
    names, m = ["c", "a", "b"], 13
    orders = []
    for name in sorted(names):
        offset, step = sharding._number(f"offset:{name}") % m, sharding._number(f"step:{name}") % (m - 1) + 1
        orders.append([(offset + k * step) % m for k in range(m)])
    table, turn = {}, 0
    while len(table) < m:
        slot = next(s for s in orders[turn % 3] if s not in table)
        table[slot] = sorted(names)[turn % 3]
        turn += 1
    assert [names[k] for k in sharding.lookup_table(names, m)] == [table[s] for s in range(m)]


def test_shards_are_even_and_stay(spark):
    names = [f"s{k}" for k in range(20)]
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    counts = np.bincount(before)
    assert counts.max() - counts.min() <= 1
    moved = (before != after) & (before != 19)
    assert moved.mean() < 0.1
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, "x")], "doc_id int, shard string")
    got = sharding.assign_shards(docs, names).collect()
    assert len(got) == 4 and got[0].shard == got[1].shard and all(r.shard in names and names[before[r.slot]] == r.shard for r in got)
    assert sharding.assign_shards(docs.limit(0), names).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_sharding_query_places_every_row_by_its_hash(spark):
    rows = entry.op2_lookup_sharding(spark, DATA).collect()
    table = sharding.lookup_table([f"shard-{k:03d}" for k in range(64)])
    assert len(rows) == 1000
    for r in rows:
        slot = int(hashlib.md5(f"k{r.doc_id}".encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert r.slot == slot and r.shard == f"shard-{table[slot]:03d}"


def test_mixing_agrees_with_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = duck.execute(entry.oracle_sql()["op3_source_mixing"]).df()
    ours = entry.op3_source_mixing(spark, DATA).toPandas()[list(theirs.columns)]
    key = list(theirs.columns)
    assert ours.sort_values(key).reset_index(drop=True).astype(theirs.dtypes.to_dict()).equals(theirs.sort_values(key).reset_index(drop=True))


def test_raking_meets_explicit_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), "w " * int(rng.integers(5, 50)), rng.choice(["a", "b", "b", "b"]).item(), rng.choice(["x", "y"]).item(), 1) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, rate int")
    mix = mixing.Mix(share=0.3, explicit={"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}}, topic=F.when(F.col("doc_id") % 2 == 0, "even"))
    kept = mixing.mixed_sample(docs, mix).toPandas()
    tokens = kept.groupby("source").n_tokens.sum() / kept.n_tokens.sum()
    langs = kept.groupby("lang").n_tokens.sum() / kept.n_tokens.sum()
    assert abs(tokens["a"] - 0.5) < 0.05 and abs(langs["x"] - 0.75) < 0.05 and set(kept.topic) == {"even", ""}
    assert kept.rate.between(0, 1).all() and abs(kept.n_tokens.sum() / sum(len(t.split()) for _, t, *_ in rows) - 0.3) < 0.03
    assert mixing.sample_mix(docs).columns == docs.columns
    sums = mixing.marginals(mixing.raked_cells(docs, mix), ["source", "lang", "topic"]).toPandas()
    assert sums.residual.max() < 1e-3 and len(sums) == 6
    more = mixing.Mix(share=0.9, explicit={"source": {"a": 9, "b": 1}})  # more of a than there is
    off = mixing.marginals(mixing.raked_cells(docs, more), ["source"]).toPandas().set_index("category")
    assert off.reached["a"] == pytest.approx(sum(len(t.split()) for _, t, s, *_ in rows if s == "a")) and off.residual["a"] > 0.3


def test_targets_ask_for_no_more_than_there_is(spark):
    rng = np.random.default_rng(6)
    for share, power in ((0.7, 0.5), (0.95, 0.0), (1.0, 0.5), (0.2, 1.0)):
        base = rng.integers(1, 5000, 9).astype(float)
        cells = spark.createDataFrame([(f"c{k}", int(b)) for k, b in enumerate(base)], "source string, base bigint")
        got = np.array([r.target for r in mixing.tempered_targets(cells, "source", power, share * base.sum()).orderBy("source").collect()])
        low, high = 0.0, 1e9
        for _ in range(200):  # the level by bisection
            middle = (low + high) / 2
            low, high = (middle, high) if np.minimum(base, middle * base**power).sum() < share * base.sum() else (low, middle)
        assert np.allclose(got, np.minimum(base, high * base**power), rtol=1e-9) and got.sum() == pytest.approx(share * base.sum())


def test_raking_beyond_the_bound_is_the_same(spark, monkeypatch):
    """More cells than are kept in one partition or broadcast."""
    rng = np.random.default_rng(5)
    rows = [(int(k), "w " * int(rng.integers(1, 9)), f"s{rng.integers(0, 20)}", f"l{rng.integers(0, 5)}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    few = sorted(map(tuple, mixing.mixed_sample(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 7)
    assert sorted(map(tuple, mixing.mixed_sample(docs).collect())) == few and len(few) > 1000


def test_mixing_edge_cases(spark):
    rows = [(None, "a b", None, None), (1, None, "s", "l"), (2, "", "s", "l"), (3, "a b c", "s", "l"), (3, "a b c", "s", "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    kept = mixing.mixed_sample(docs, mixing.Mix(share=1.0)).collect()
    assert sorted(r.n_tokens for r in kept) == [0, 0, 2, 3, 3]
    assert mixing.mixed_sample(docs.where('doc_id < 3')).count() == 0  # no cell has a word
    assert mixing.mixed_sample(docs.limit(0)).count() == 0
    names = ["_source", "_tokens", "_rate", "cell_source", "CELL_TOPIC", "n_tokens", "rate", "weight", "a.b", "_own_topic", "topic"]
    wide = docs.select("*", *(F.lit("mine").alias(n) for n in names))
    for row in mixing.sample_mix(wide, mixing.Mix(share=1.0)).collect():
        assert list(row)[4:] == ["mine"] * len(names)
    assert mixing.mixed_sample(wide, mixing.Mix(share=1.0)).select("_source", "`a.b`", "_own_topic").distinct().collect() == [("mine", "mine", "mine")]


def luhn(digits):
    values = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, e, ok in BASE for m in re.finditer(e, text or "") if ok(m.group())]


HARD = [
    None, "", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "x1.2.3.999 000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (499) 555-6503.", "+12-", "😀 é a.b@c-d.e.f! 10.0.0.1",
    "9" * 30000, "a" * 30000 + "@b.c", "." * 2000 + "@x.y", "+1 " + "(" * 3000 + "2345678", "a@b@c.d", "1.1.1.1@2.2", "0 " * 5000, "4111111111111111" * 3,
]


def test_base_spans_of_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).select("doc_id", pii.written(F.col("base")).alias("spans")).collect()}
    for k, text in enumerate(HARD):
        assert got[k] == ",".join(brute_spans(text)), repr(text)[:60]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_random_texts(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("01259.@+-( )a%é\n"), 80)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pii.find_personal_data(docs).select("doc_id", pii.written(F.col("base")).alias("spans")).collect():
        assert r.spans == ",".join(brute_spans(texts[r.doc_id]))


def test_query_keeps_base_spans(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entry.op7_contextual_pii(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert r.spans.split(",")[: len(spans)] == spans or not spans
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in spans) for k, *_ in BASE)


def test_patterns_find_unseen_identifiers(spark):
    texts = [f"please write to joe{k}@mail.example.com today" for k in range(8)] + ["write to user_99887766 today", "it cost item-20240101x overall", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.found] for r in pii.find_personal_data(docs).collect()}
    assert found[8] == ["user_99887766"] and found[9] == [] and all(not found[k] for k in (*range(8), 10))


def test_many_matches_take_time_in_proportion(spark):
    """Beside the runs of a usual size, one text of 100,000 addresses and as many identifiers."""
    def seconds(n):
        text = " ".join(f"write to u{k}@m{k}.org or to user_{k:08d} now" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
        begin = time.monotonic()
        row = pii.find_personal_data(docs).select(F.size("base").alias("base"), F.size("found").alias("found"), F.element_at("base", -1).alias("last")).first()
        assert (row.base, row.found) == (n, n)
        m = list(re.finditer(r"u[0-9]+@\S+", text))[-1]
        assert (row["last"].start, row["last"].end) == (m.start(), m.end())
        return time.monotonic() - begin

    seconds(1000)
    assert seconds(100_000) < 10 * max(seconds(20_000), 1)


def test_identifiers_of_a_table_are_found_by_context(spark):
    """Handles take the place of a third of the planted addresses: nearly all are found, and hardly anything else."""
    rng = np.random.default_rng(12)
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").orderBy("doc_id").collect()]
    rows, planted = [], {}
    for k, text in enumerate(texts):
        text = re.sub(r"[0-9@]", "x", text)
        before, after = [("mailto", "pending"), ("reach", "directly"), ("account", "verified")][k % 3]
        value = f"handle_{int(rng.integers(10**8, 10**9))}" if k % 9 == 4 else f"u{k}@mail{k % 7}.example.org"
        noise = f" invoice 2024{k:06d}x total"
        rows.append((k, f"{text} {before} {value} {after}{noise}"))
        if "@" not in value:
            planted[k] = value
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r.doc_id: {rows[r.doc_id][1][s.start : s.end] for s in r.found} for r in pii.find_personal_data(docs).collect()}
    right = sum(found[k] == {v} for k, v in planted.items())
    assert right >= 0.95 * len(planted) > 50 and sum(map(len, found.values())) <= right / 0.95


def test_pattern_scores_are_those_of_the_formula(spark):
    edges = [("p", "s1", 2, 10), ("p", "s2", 1, 10), ("p", "u", 1, 10), ("q", "u", 3, 1), ("q", "v", 1, 1)]
    frame = spark.createDataFrame(edges, "pattern string, instance string, n int, seen int")
    got = {r.pattern: (r.confidence, r.support) for r in pii.score_patterns(frame, spark.createDataFrame([("s1",), ("s2",)], "instance string"), 2).collect()}
    u = 0.9 * 3 / 10
    assert got["p"] == pytest.approx(((3 + u) / 10, 3)) and got["q"] == pytest.approx((3 * u / 4, 2))
    assert pii.score_patterns(frame, spark.createDataFrame([], "instance string")).agg(F.max("confidence")).first()[0] == 0
    frame = spark.createDataFrame([*edges, ("r", "s1", 1, 3), ("r", "s2", 1, 3), ("r", "u", 1, 3)], "pattern string, instance string, n int, seen int")
    old, pii.CONFIDENCE = pii.CONFIDENCE, 0.6
    try:
        got = {r.pattern: (r.confidence, r.support) for r in pii.score_patterns(frame, spark.createDataFrame([("s1",), ("s2",)], "instance string"), 2).collect()}
    finally:
        pii.CONFIDENCE = old
    u = 1 - (1 - 0.9 * 3 / 10) * (1 - 0.9 * 2 / 3)
    assert got["p"] == pytest.approx(((3 + u) / 10, 3)) and got["r"] == pytest.approx(((2 + u) / 3, 3)) and got["q"] == pytest.approx((3 * u / 4, 2))


def test_words_are_counted_in_whole_texts(spark):
    texts = spark.createDataFrame([("The the, THE end_of the",), (None,), ("",), ("the the " * 5000,), ("1 2",)], "text string")
    wanted = spark.createDataFrame([("the",), ("the the",), ("end_of the",), ("no such",)], "words string")
    assert {tuple(r) for r in pii.word_counts(texts, wanted).collect()} == {("the", 10_004), ("the the", 10_001), ("end_of the", 1)}


def test_planted_secrets_are_found_by_context(spark):
    """The documents as they are: secrets stand after the word token. Recall and precision over the whole table; no frequent word is a pattern."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {(k, m.start(1), m.end(1)) for k, t in texts.items() for m in re.finditer(r'(?i)token\W+"([0-9a-f]{20,})"', t)}
    found = {(r.doc_id, s.start, s.end) for r in pii.find_personal_data(docs).where(F.size("found") > 0).collect() for s in r.found}
    assert len(planted) > 100 and len(found & planted) >= 0.8 * len(planted) and len(found & planted) >= 0.9 * len(found)


def exact(ids, x, query, k):
    scores = (x * x[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]]
    return [(int(ids[i]), float(scores[i])) for i in order[:k]]


def test_recall_of_the_search(spark):
    """All queries of a table that is larger than what is verified."""
    table = spark.read.parquet(f"{LARGER}/embeddings.parquet").toPandas()
    table = table.sort_values("vec_id")
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    settings, got = ann.Collisions(), {}
    lines, longest = ann.directions(x.shape[1], settings), float(np.sqrt((x**2).sum(axis=1)).max())
    block = ann.Block(ids, x, longest, lines, settings)
    begin, end = block.windows(x[::20] @ lines[:-1])
    assert np.mean([len(block.candidates(*w)) for w in zip(begin, end, strict=True)]) < 0.2 * len(ids)
    for r in entry.op5_collision_search(spark, LARGER).collect():
        got.setdefault(r.query_id, []).append(r)
    queries = [k for k in range(len(ids)) if ids[k] % 20 == 0]
    assert sorted(got) == sorted(int(ids[k]) for k in queries)
    hits = 0
    for k in queries:
        rows = sorted(got[ids[k]], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        want = dict(exact(ids, x, k, 20))
        hits += sum(r.vec_id in want for r in rows)
        assert all(r.score == pytest.approx(x[k] @ x[np.searchsorted(ids, r.vec_id)], abs=1e-12) for r in rows)
        assert all(a.score > b.score or a.score == b.score and a.vec_id < b.vec_id for a, b in zip(rows, rows[1:]))
    assert hits / (20 * len(queries)) >= 0.95


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    ids = np.arange(3000)
    settings, lines = ann.Collisions(), ann.directions(24, ann.Collisions())
    longest = float(np.sqrt((x**2).sum(axis=1)).max())
    blocks = [ann.Block(ids[s], x[s], longest, lines, settings) for s in (slice(0, 1500), slice(1500, 3000))]
    hits = 0
    for q in range(0, 3000, 100):
        found = []
        for b in blocks:
            begin, end = b.windows((x[q] @ lines[:-1])[None])
            found += list(zip(*ann.best(b.ids, b.vectors, q, x[q], b.candidates(begin[0], end[0]), 20, longest), strict=True))
        top = [i for i, _ in sorted(found, key=lambda p: (-p[1], p[0]))[:20]]
        hits += len(set(top) & {i for i, _ in exact(ids, x, q, 20)})
    assert hits / (20 * 30) >= 0.9


def test_equal_vectors_have_equal_scores():
    rng = np.random.default_rng(13)
    for _ in range(300):
        x = rng.standard_normal((64, 64))[rng.integers(0, 8, int(rng.integers(30, 300)))]
        ids, query = rng.permutation(len(x)), rng.standard_normal(64)
        found, scores = ann.best(ids, x, -1, query, np.arange(len(x)), 20, 20.0)
        want = sorted(((float((v * query).sum()), -int(i)) for v, i in zip(x, ids, strict=True)), reverse=True)[:20]
        assert [(s, -int(i)) for s, i in zip(scores, found, strict=True)] == want


def test_search_in_groups(spark, monkeypatch):
    """Vectors and queries in several groups and blocks, with everything verified: the exact answer."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "GROUP_BYTES", 8 * 8 * 100)
    rng = np.random.default_rng(14)
    x = np.repeat(rng.standard_normal((150, 8)), 2, axis=0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist())], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 2 == 0, 5, ann.Collisions(least=10**6)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {k: [i for i, _ in exact(np.r_[np.arange(300), 0], np.vstack([x, x[:1]]), k, 5)] for k in range(0, 300, 2)}


def test_search_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0 and ann.nearest(df, F.lit(False)).count() == 0
    same = spark.createDataFrame([(k, [0.6, 0.8]) for k in range(3000)], "vec_id bigint, embedding array<float>")
    assert [r.vec_id for r in ann.nearest(same, F.col("vec_id") == 5).orderBy("rank").collect()] == [k for k in range(21) if k != 5]
