"""Near-duplicates, line dedup and the pipeline against brute force."""

import re

import numpy as np
import pytest

import corpus_pipeline
from cloudframe.llm import components, entry, line_dedup, near_dups

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, base=400):
    return [f"w{x}" for x in rng.integers(0, base, n)]


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(texts, threshold=0.8):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j]), 1) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(texts))]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.sort(keys[:220]), np.sort(keys[60:])
    wa, wb = rng.uniform(0.5, 4, 220), rng.uniform(0.5, 4, 240)
    x, y = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    every = set(x) | set(y)
    truth = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))
    signed = near_dups.prob_min_hash([a, b], [wa, wb], 4000)
    assert (signed[0] == signed[1]).mean() == pytest.approx(truth, abs=0.035)
    assert (near_dups.prob_min_hash([a], [wa * 7], 500) == near_dups.prob_min_hash([a], [wa], 500)).all()
    one = near_dups.prob_min_hash([keys[:1]], [np.ones(1)], 360)
    assert (one == keys[0]).all() and near_dups.prob_min_hash([], [], 360).shape == (0, 360)


def test_query_gives_the_brute_force_classes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    rows = entry.op4_near_duplicates(spark, DATA).collect()
    ids = [d.doc_id for d in docs]
    want = dict(zip(ids, (ids[k] for k in classes([d.text for d in docs])), strict=True))
    assert {r.doc_id: r.class_id for r in rows} == want
    assert {r.doc_id for r in rows if r.is_kept} == set(want.values())


def test_groups_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = words(rng, 120)
    near = []
    for _k in range(60):
        copy = list(base)
        copy[int(rng.integers(0, 120))] = f"x{int(rng.integers(0, 10**6))}"
        near.append(" ".join(copy))
    rows = [(k, t, "n") for k, t in enumerate(near)] + [(100 + k, " ".join(base).upper() + "  \n", "c") for k in range(50)]
    rows += [(500, None, "e"), (501, "", "e"), (502, " \n", "e"), (None, "one two", "s"), (503, "One  TWO", "s"), (504, "one", "s"), (504, "one", "s"), (505, " ".join(words(rng, 30_000)), "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, class_id string").repartition(3)
    got = near_dups.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.class_id, []).append(r)
    assert len(by[0]) == 110 and by[0][0].class_rows == 110 and sum(r.is_kept for r in by[0]) == 1
    assert all(len(by[k]) == 1 and by[k][0].is_kept for k in (500, 501, 502, 505))
    assert sorted((r.doc_id is None) for r in by[503]) == [False, True] and len(by[504]) == 2 and sum(r.is_kept for r in by[504]) == 1
    kept = near_dups.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 500, 501, 502, 503, 504, 505]
    assert near_dups.near_duplicate_classes(docs.limit(0)).count() == 0 and near_dups.keep_one_of_each(docs.limit(0)).count() == 0


def test_near_pairs_of_unequal_repeats(spark):
    """A repeated passage changes counts, not the set, so it mustn't keep a pair from meeting."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(16):
        passage, rest = words(rng, 110, 10**6), words(rng, 90, 10**6)
        changed = [*rest[:45], "changed", *rest[46:]]
        texts += [" ".join(passage + rest), " ".join(passage * 100 + changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(docs).collect()}
    want = classes(texts)
    assert want == [k - k % 2 for k in range(32)] and [got[k] for k in range(32)] == want


def test_drifting_group_loses_no_link(spark):
    """Copies of copies: few are like the first, and blocks are smaller than the buckets."""
    rng = np.random.default_rng(3)
    texts, current = [], words(rng, 150)
    for k in range(160):
        current = list(current)
        current[int(rng.integers(0, 150))] = f"y{k}"
        texts.append(" ".join(current))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for sketch in (near_dups.Sketch(block=16), near_dups.Sketch(block_bytes=20_000)):
        got = {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(docs, sketch).collect()}
        assert [got[k] for k in range(160)] == classes(texts)


def test_spanning_links_are_those_of_all_pairs():
    """Fewer links than nodes, and the same components as all links between the two blocks."""
    rng = np.random.default_rng(9)
    for trial in range(30):
        n, base = 40, rng.choice(10**6, 60, replace=False)
        sets = [np.unique(np.r_[base[rng.random(60) < 0.93], rng.integers(0, 9, int(rng.integers(1, 6)))]) for _ in range(n)]
        node, first = rng.permutation(1000)[:n], rng.random(n) < 0.5
        second = first if trial % 3 == 0 else ~first
        component = np.where(rng.random(n) < 0.2, node.min(), node)
        got = near_dups.spanning_links(node, component, first, second, sets, 0.8)
        parent = {int(x): int(x) for x in node}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def joined(pairs):
            parent.update((x, x) for x in parent)
            for a, b in pairs:
                parent[find(int(a))] = find(int(b))
            return len({find(x) for x in parent})

        known = [(a, b) for a, b in zip(node, component, strict=True) if a != b]
        every = [(node[i], node[j]) for i in range(n) for j in range(i) if ((first[i] and second[j]) or (first[j] and second[i])) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        assert set(got) <= {(min(a, b), max(a, b)) for a, b in every}
        assert joined(known) - len(got) == joined(known + got) == joined(known + every)


def test_near_dups_beside_clashing_names(spark):
    rng = np.random.default_rng(10)
    text = " ".join(words(rng, 60))
    names = ["_id", "_h1", "_h2", "_x1", "x1", "h1", "h2", "KEPT_ID", "words", "node", "bands", "a.b", "row", "component"]
    docs = spark.createDataFrame([(1, text, *names), (2, text + " end", *names), (3, None, *names)], ["doc_id", "text", *names])
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = near_dups.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, text, *names), (3, None, *names)]


def dedup(rows):
    """rows of (doc_id, text) in order; the slow way."""
    earlier, out = [], []
    for _, text in rows:
        left = []
        for line in text.split("\n"):
            w = line.lower().split()
            if len(w) >= line_dedup.MIN_WORDS:
                near = len(w) >= line_dedup.MIN_EDIT_WORDS
                gone = any(w == e or near and len(e) >= line_dedup.MIN_EDIT_WORDS and distance(w, e) <= 1 for e in earlier)
                earlier.append(w)
                if gone:
                    continue
            left.append(line)
        out.append("\n".join(left))
    return out


def distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_one_word_apart():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = words(rng, int(rng.integers(1, 7)), 3)
        b = words(rng, int(rng.integers(1, 7)), 3)
        assert line_dedup.within_one_word(a, b) == (distance(a, b) <= 1)


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(words(rng, int(n), 30)) for n in rng.integers(1, 16, 60)]
    rows = []
    for doc in range(60):
        lines = []
        for line in rng.choice(pool, 6):
            w = line.split(" ")
            kind, at = rng.integers(0, 5), int(rng.integers(0, len(w)))
            if kind == 0:
                w[at] = "Zz"
            elif kind == 1:
                w.insert(at, "new")
            elif kind == 2:
                del w[at]
            lines.append("  ".join(w) if kind == 3 else " ".join(w))
        rows.append((doc, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for (doc, text), want in zip(rows, dedup(rows), strict=True):
        assert got[doc].text == want
        assert got[doc].n_lines == len(text.split("\n")) and got[doc].n_dropped == len(text.split("\n")) - (len(want.split("\n")) if want or got[doc].n_dropped < got[doc].n_lines else 0)


def test_short_lines_and_spaces(spark):
    rows = [
        (1, "the committee met again on the first tuesday of march\nyes\nfour words make one\nsee https://example.org/a/long/path for details"),
        (2, "the committee met again on the frist tuesday of march\nYES\nfour words make two"),
        (3, "see https://example.org/some/other for details\nsee https://example.org/a/long/pathx for details\nsee https://example.org/a/long/psth for details"),
        (4, "alpha betagamma delta epsilon\nalpha beta gamma delta epsilon\nalpha beta gamma deltaepsilon"),
        (5, "one two three four five six seven eight nine ten elev en\none two three four five six seven eight nine ten eleven"),
        (6, "uno dos trescuatro\nuno dos tres cuatro\nunodos tres cuatro\ntwo of\ntwoof"),
    ]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got[1] == rows[0][1] and got[2] == ""
    assert got[3] == "see https://example.org/some/other for details"
    assert got[4] == "alpha betagamma delta epsilon" and got[5] == rows[4][1].split("\n")[0]
    assert got[6] == "uno dos trescuatro\ntwo of\ntwoof"


def test_short_lines_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    pool = ["a", "bc", "def", "ab", "c", "abcdefghijklmnop", "abcdefghijklmnoq", "abcdefghijklmno", "d"]
    lines = [" ".join(rng.choice(pool, rng.integers(1, 6), p=[0.3, 0.2, 0.05, 0.1, 0.1, 0.08, 0.06, 0.06, 0.05])) for _ in range(700)]
    want, split = [], [x.split() for x in lines]
    for k, w in enumerate(split):
        want.append("" if any(w == e or line_dedup.near_lines(w, e) for e in split[:k]) else lines[k])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[k] for k in range(len(lines))] == want and len([x for x in want if x]) > 20


def test_lines_of_few_words_by_characters(spark):
    """One to three words, from twelve characters on: edit distance of characters, all pairs."""
    rng = np.random.default_rng(17)
    lines = []
    for _ in range(500):
        line = list(rng.choice(["alphabetical", "alphabet soup", "one two threes", "twelve chars", "short"]))
        for _ in range(int(rng.integers(0, 3))):
            at, kind = int(rng.integers(0, len(line))), int(rng.integers(0, 3))
            line[at : at + (kind != 1)] = [] if kind == 0 else [str(rng.choice(list("xyz")))]
        lines.append("".join(line))
    out, earlier = [], []
    for line in lines:
        near = any(line == e or min(len(line), len(e)) >= 12 and distance(line, e) <= 1 or " ".join(line.split()) == e for e in earlier)
        out.append("" if near else line)
        earlier.append(line)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    # A dropped or added space is near by a rule of its own, whatever the length.
    differ = [k for k in range(len(lines)) if got[k] != out[k]]
    assert all(got[k] == "" and any(line_dedup.near_lines(lines[k].split(), e.split()) for e in lines[:k]) for k in differ) and len(differ) < 20
    assert 20 < sum(bool(x) for x in out) < 450


def test_line_edge_cases(spark):
    long = " ".join(f"v{k}" for k in range(20_000))
    rows = [(1, None, 5), (2, "", 5), (3, "a b c\na b c\n\n\nx", 5), (4, "A  b c", 5), (None, "a b c\nq r s", 5), (6, long, 5), (7, long + " end", 5), (8, "k l m", 5), (8, "k l m", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [(1, None, 0), (2, "", 0), (3, "a b c\n\n\nx", 1), (4, "", 1), (6, long, 0), (7, "", 1), (8, "k l m", 0), (8, "k l m", 0), (None, "q r s", 1)]
    kept = line_dedup.keep_new_lines(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 8, 8]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def dedup_all(rows):
    """As dedup(), by the operator's own rule for near lines, for a whole table.

    near_lines() holds only for lines that share the first or the last half of the shorter
    one's words, or all letters, so the slow way looks among those alone.
    """
    seen, by_part, out = set(), {}, []
    for _, text in rows:
        left = []
        for line in text.split("\n"):
            w = line.lower().split()
            if not w:
                left.append(line)
                continue
            parts = [("letters", "".join(w))]
            if len(w) < 4:
                c = " ".join(w)
                parts += [(n, side, x) for n in {len(c) - 1, len(c), len(c) + 1} for side, x in (("head", c[: min(n, len(c)) // 2]), ("foot", c[len(c) - min(n, len(c)) // 2 :]))]
            for n in {len(w) - 1, len(w), len(w) + 1}:
                parts += [(n, "first", tuple(w[: min(n, len(w)) // 2])), (n, "last", tuple(w[len(w) - min(n, len(w)) // 2 :]))]
            gone = tuple(w) in seen or any(line_dedup.near_lines(w, e) for part in parts for e in by_part.get(part, ()))
            if tuple(w) not in seen:
                seen.add(tuple(w))
                mine = [("letters", "".join(w))]
                if len(w) < 4:
                    mine += [(len(c), side, x) for n in {len(c) - 1, len(c), len(c) + 1} for side, x in (("head", c[: min(n, len(c)) // 2]), ("foot", c[len(c) - min(n, len(c)) // 2 :]))]
                for n in {len(w) - 1, len(w), len(w) + 1}:
                    low = min(n, len(w))
                    mine += [(len(w), "first", tuple(w[: low // 2])), (len(w), "last", tuple(w[len(w) - low // 2 :]))]
                for part in set(mine):
                    by_part.setdefault(part, []).append(w)
            if not gone:
                left.append(line)
        out.append("\n".join(left))
    return out


def test_line_query_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in entry.op10_line_dedup(spark, DATA).collect()}
    want = dedup_all([(d.doc_id, d.text) for d in docs])
    assert [got[d.doc_id].text for d in docs] == want and sum(r.n_dropped for r in got.values()) > 1000


def test_lines_beyond_the_broadcast_bounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    pool = [" ".join(words(rng, int(n), 30)) for n in rng.integers(3, 12, 40)]
    rows = [(k, "\n".join(rng.choice(pool, 5))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == want


def test_lines_beside_clashing_names(spark):
    names = ["_id", "_f1", "f1", "_f2", "_gone", "GONE", "_lines", "lines", "n_lines", "n_dropped", "gone_id", "a.b"]
    docs = spark.createDataFrame([(1, "a b c d\na b c d", *names), (2, "a b c d", *names)], ["doc_id", "text", *names])
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *(n for n in names if n not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r._gone, r.n_dropped) for r in got.collect()) == [(1, "a b c d", "_gone", 1), (2, "", "_gone", 1)]
    kept = line_dedup.keep_new_lines(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d", *names)]


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(6)
    prose = [" ".join(words(rng, 200, 5000)) for _ in range(40)]
    copy = prose[0].split(" ")
    copy[100] = "changed"
    shared = " ".join(words(rng, 60, 5000))
    rows = [(k, t + ("\n" + shared if k % 4 == 0 else ""), "en", f"s{k % 3}", len(t)) for k, t in enumerate(prose)]
    rows += [(100, prose[1], "en", "s0", 1), (101, " ".join(copy), "en", "s1", 1), (102, "too short", "en", "s0", 1), (103, None, None, None, None), (104, "spam " * 300, "en", "s0", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == set(range(40)) | {100, 101}
    assert [shared in kept[1][k] for k in (0, 4, 36)] == [True, False, False] and 100 not in kept[1]
    assert set(kept[2]) <= set(kept[1]) and set(range(40)) <= set(kept[2])
    assert set(kept[3]) < set(kept[2])
    assert {r.doc_id for r in docs.collect()} == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows at all; then nulls, repeated rows, and columns named as the stages' own."""
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rng = np.random.default_rng(16)
    texts = [" ".join(words(rng, 120, 5000)) for _ in range(12)]
    names = ["kept", "topic", "n_lines", "h1", "rate", "token_ids", "start", "_id", "part"]
    rows = [(k, t, "en", "s", 1, *names) for k, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1, *names), (None, texts[3] + " more", None, None, None, *names), (50, None, None, "s", 0, *names)]
    wide = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names))
    wide.write.parquet(f"{tmp_path}/wide/documents.parquet")
    docs = wide
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, f"{tmp_path}/wide").write.parquet(f"{tmp_path}/wide/{k}")
        docs = spark.read.parquet(f"{tmp_path}/wide/{k}")
        assert docs.columns == wide.columns and all(tuple(r)[5:] == tuple(names) for r in docs.collect())
    assert 0 < docs.count() <= 12 and len({r.doc_id for r in docs.collect()}) == docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/wide").collect()} == {r.doc_id for r in docs.collect()}


def test_every_query_is_registered():
    names = list(entry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_shingles_weigh_as_many_letters_as_they_have():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 5, 6, 40, 400):
        words = ["".join(rng.choice(list("abcdé"), int(rng.integers(1, 9)))) for _ in range(n)]
        words += words[: n // 2]
        hashes, weights = near_dups.weighted_shingles(" ".join(words), 5)
        assert hashes.tolist() == near_dups.shingles(" ".join(words), 5).tolist()
        want = {}
        for k in range(max(1, len(words) - 4) if words else 0):
            want[near_dups.shingles(" ".join(words[k : k + 5]), 5)[0]] = len("".join(words[k : k + 5]))
        assert dict(zip(hashes.tolist(), weights.tolist(), strict=True)) == {int(k): float(v) for k, v in want.items()}


def test_signatures_of_texts_estimate_weighted_similarity():
    """Two texts that share 80 of 100 shingles, the shared ones the longer: by letters they are more alike."""
    sketch = near_dups.Sketch()
    m = 4000
    both = " ".join(f"sharedword{k}number" for k in range(84))
    sets = [near_dups.weighted_shingles(f"{both} {tail}", 5) for tail in (" ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20)))]
    a, b = (dict(zip(h.tolist(), w.tolist(), strict=True)) for h, w in sets)
    true = sum(a[k] for k in a.keys() & b.keys()) / sum((a | b).values())
    signed = near_dups.prob_min_hash([h for h, _ in sets], [w for _, w in sets], m)
    assert true > len(a.keys() & b.keys()) / len(a.keys() | b.keys()) + 0.05
    assert abs(float((signed[0] == signed[1]).mean()) - true) < 4 * (true * (1 - true) / m) ** 0.5 + 0.01 and sketch.rows * sketch.bands == 360
