"""Token counts, packing, language id and quality rules against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cloudframe.llm import entry, langid, packing, quality, token_counts

DATA = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n", "a", "é" * 50, "it's <|endoftext|> here", "x" * 5000, "word " * 3000, "tab\tand\r\n  spaces   ", "日本語のテキスト 😀", "$$$ ### 123.45"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "keep", 7) for k, t in enumerate(ODD + ODD[-2:])], "doc_id bigint, text string, source string, n_tokens int")


def test_token_counts(spark, library, odd):
    for row in token_counts.count_tokens(odd, JSON).collect():
        text = row.text or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False)))
        assert row.over_limit == (row.n_tokens > 512) and row.source == "keep"
    docs = entry.op9_token_counts(spark, DATA).toPandas().set_index("doc_id").n_tokens
    for row in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        assert docs[row.doc_id] == len(library.encode(row.text, add_special_tokens=False))
    assert token_counts.count_tokens(odd.limit(0), JSON).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n\t.,9é😀s "), max_size=400), st.integers(1, 40))
def test_pieces_of_a_text_count_as_the_whole(text, limit):
    pieces = list(token_counts.safe_pieces(text, limit))
    assert "".join(pieces) == text
    tokenizer = token_counts.load_tokenizer(JSON)
    assert sum(len(tokenizer.encode(p, add_special_tokens=False)) for p in pieces) == len(tokenizer.encode(text, add_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_both_libraries_give_the_same_ids(text):
    assert packing.encode(text, RANKS, JSON)[:-1].tolist() == token_counts.load_tokenizer(JSON).encode(text, add_special_tokens=False).ids


def check_packing(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = ids[doc][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    assert by_doc.keys() == ids.keys()
    total = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
        padded += at if at & (at - 1) == 0 else 1024
    return padded / max(1, total)


def test_packing_of_documents(spark, library, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert check_packing(entry.op8_squares_packing(spark, DATA).collect(), ids) == 1.0
    small = odd.limit(12)
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in small.collect()}
    rows = packing.pack_documents(small.repartition(3), RANKS, JSON).collect()
    check_packing(rows, ids)
    assert all(r.token_ids == ids[r.doc_id][r.start : r.start + r.length] for r in rows)
    assert packing.pack_documents(odd.limit(0), RANKS, JSON).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, RANKS, JSON, window=1000)


def test_texts_that_the_faster_library_refuses(library):
    text = " " * 1_000_000 + "x"
    assert packing.encode(text, RANKS, JSON)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("max_open", [3, 40, 2048])
def test_packer_places_by_least_squares(max_open):
    rng = np.random.default_rng(0)
    packer, seen, sizes = packing.SquaresPacker(16, max_open), [], rng.integers(1, 40, 4000)
    for doc, size in enumerate(sizes):
        before, filled, rest = packer.counts.copy(), packer.closed["filled"], int(size) % 16
        choices = {}
        for level in range(17 - rest):
            if level and not before[level]:
                continue
            after = before.copy()
            after[level] -= level > 0
            if level + rest < 16:
                after[level + rest] += 1
            choices[level] = int((after**2).sum())
        seen += list(packer.add(doc, np.full(int(size), doc, "<u4")))
        if packer.closed["filled"] == filled:
            assert (packer.counts**2).sum() == (min(choices.values()) if rest else (before**2).sum())
        assert packer.n_open == packer.counts.sum() and packer.n_tokens == (packer.counts * np.arange(17)).sum()
        assert packer.n_open <= max(max_open, 16)
    seen += list(packer.finish())
    full = Counter(r[5] for r in seen for _ in range(r[2]))
    assert all(v == 16 or v & (v - 1) == 0 for v in full.values()) and sum(v < 16 for v in full.values()) == packer.closed["last"] < 5
    assert Counter(r[0] for r in seen for _ in range(r[2])) == dict(enumerate(sizes))
    # A rest is cut at most once for each sequence that was filled up or comes last.
    cuts = sum(n - 1 for n in Counter(r[0] for r in seen).values()) - sum(int(x) // 16 - (x % 16 == 0) for x in sizes)
    assert cuts <= packer.closed["filled"] + packer.closed["last"]


def test_language_of_held_out_documents(spark):
    got = entry.op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth).query("held_out")
    assert len(got) == len(truth) and (both.lang == both.lang_pred).mean() > 0.97
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in both.doc_id) and got.score.between(0, 1).all()


def test_slices_lose_no_ngrams(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abİßñ 1.\n"), int(n))) for n in rng.integers(0, 90, 60)] + ["...", "a", "   b   " * 9]

    def found():
        out = Counter()
        for rows, parts, carried in langid.slices(texts):
            part, bucket = langid.hashed_ngrams(parts, carried)
            out.update(zip(np.array(rows)[part].tolist(), bucket.tolist(), strict=True))
        return out

    whole = found()
    for size in (1, 2, 3, 7, 20):
        monkeypatch.setattr(langid, "SLICE", size)
        assert found() == whole


def test_predictions_are_those_of_the_formula(spark):
    """Naive Bayes over n-grams of whole texts, written anew with dictionaries."""
    rows = [(k, "".join(np.random.default_rng(k).choice(list("abcdé '.0") if k % 2 else list("aefgh  -1"), 60)), "ab"[k % 2]) for k in range(30)]

    def grams(text):
        text = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
        windows = [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]
        return [langid.hashed_ngrams([w], [len(w) - 1])[1][-1].item() for w in windows if w != " "]

    train = [r for r in rows if r[0] % 3]
    counts = {x: Counter(g for _, t, lang in train if lang == x for g in grams(t)) for x in "ab"}
    model = langid.fit(spark.createDataFrame(train, "doc_id int, text string, lang string"))
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t, _ in rows], "doc_id int, text string, _guess string, guess double")
    for r in langid.identify_languages(docs, model).collect():
        own = grams(rows[r.doc_id][1])
        logs = {x: np.log(sum(lang == x for *_, lang in train) / len(train)) + sum(np.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * 2**langid.BITS)) for g in own) for x in "ab"}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-4) and (r._guess, r.guess) == ("x", 1.0)


def slow_bucket(gram):
    """The bucket of an n-gram, a character at a time."""
    rolled, mask = 0, 2**32 - 1
    for n, char in enumerate(gram, 1):
        rolled = (rolled * 0x01000193 & mask) ^ (ord(char) + n & mask)
    mixed = rolled * 0x9E3779B1 & mask
    mixed = (mixed ^ mixed >> 15) * 0x85EBCA6B & mask
    return mixed >> 32 - langid.BITS


def test_language_query_row_by_row(spark):
    """Every row of the query, from n-grams counted in dictionaries."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()

    def grams(text):
        text = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
        return Counter(slow_bucket(text[k : k + n]) for n in (1, 2, 3) for k in range(len(text) - n + 1) if text[k : k + n] != " ")

    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    own = {r.doc_id: grams(r.text or "") for r in docs}
    train = [r for r in docs if not held[r.doc_id] and r.text is not None and r.lang is not None]
    langs = sorted({r.lang for r in train})
    counts = {x: sum((own[r.doc_id] for r in train if r.lang == x), Counter()) for x in langs}
    totals = {x: counts[x].total() + 0.5 * 2**langid.BITS for x in langs}
    rows = {r.doc_id: r for r in entry.op1_language_id(spark, DATA).collect()}
    assert rows.keys() == held.keys()
    for r in docs:
        got = rows[r.doc_id]
        assert got.held_out == held[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        logs = [np.log(sum(t.lang == x for t in train) / len(train)) + sum(n * np.log((counts[x][b] + 0.5) / totals[x]) for b, n in own[r.doc_id].items()) for x in langs]
        assert got.lang_pred == langs[int(np.argmax(logs))] and got.score == pytest.approx(1 / np.exp(np.array(logs) - max(logs)).sum(), abs=2e-3)


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "le chat", None), (5, "", "de")]
    train = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ("de", "en")
    texts = [None, "", "123 $$", "the dog", "DIE KATZE UND DER HUND", "the dog " * 100_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, score string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs, model).collect()}
    assert [out[k][0] for k in range(6)] == ["und", "und", "und", "en", "de", "en"] and out[0][1] == 0.0 and out[5][1] == pytest.approx(1)
    nothing = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify_languages(docs, nothing).collect()} == {"und"}
    assert langid.identify_languages(docs.limit(0), model).count() == 0


def test_language_scores_are_those_of_the_formula(spark):
    rows = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("de", "die maus")]
    train = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    model = langid.fit(train, alpha=0.5)
    counts = {lang: Counter() for lang in model.languages}
    for lang, text in rows:
        counts[lang].update(langid.hashed_ngrams([text], [0])[1].tolist())
    for text in ("the mouse", "eine katze"):
        grams = langid.hashed_ngrams([text], [0])[1]
        scores = [np.log(sum(x == lang for x, _ in rows) / 3) + sum(np.log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * 2**15)) for g in grams) for lang in model.languages]
        assert model.log_likelihoods([text])[0][0] == pytest.approx(scores, abs=1e-3)


def base(text):
    """The base counts, the slow way."""
    words = quality.WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    marked = {k + n for k, w in enumerate(windows) for n in range(3) if windows.count(w) > 1}
    lines = [x for x in text.split("\n") if quality.WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(marked)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t#$\x1c\xa0é"), max_size=120))
def test_base_counts(text):
    assert quality.base_counts(text) == base(text)


def test_quality_verdicts(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvw"), rng.integers(2, 9))) for _ in range(3000)]
    good, noise = " ".join(words[:400]), " ".join("".join(map(chr, rng.integers(0x100, 0x2000, 5))) for _ in range(400))
    spam = " ".join(f"{words[k % 7]} {words[(k * k) % 11]}" for k in range(3000))
    rows = [(1, good), (2, noise), (3, spam), (4, None), (5, ""), (6, "few words"), (7, good), (8, " ".join(words * 20))]
    docs = spark.createDataFrame([(k, t, "own") for k, t in rows], "doc_id int, text string, kept string")
    out = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert out[1].kept and out[7].kept and not out[6].kept and out[6].base_failed
    assert not out[2].kept and not out[2].base_failed and out[2].quality_scores.zstd_ratio > 0.7
    assert not out[4].kept and out[4].quality_scores.n_words == 0 and not out[5].kept and not out[8].kept
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 7] and quality.keep_good(docs).columns == docs.columns
    assert quality.judge_quality(docs.limit(0)).count() == 0
    low, high = quality.Bands(), quality.Bands(whole=((0, 0.0, 0.1),))
    assert quality.in_bands(good.encode(), low, quality.zstandard.ZstdCompressor())[3]
    assert not quality.in_bands(good.encode(), high, quality.zstandard.ZstdCompressor())[3]


def test_quality_query_against_the_slow_way(spark):
    """Every document of a table: counts, limits learned from the labels, and verdicts."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))

    def counts(text):
        words = quality.WORD.findall(text)
        windows = list(zip(words, words[1:], words[2:]))
        often = {w for w, n in Counter(windows).items() if n > 1}
        marked = {k + n for k, w in enumerate(windows) if w in often for n in range(3)}
        lines = [x for x in text.split("\n") if quality.WORD.search(x)]
        return len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(marked)

    def ratio(data):
        return len(quality.zstandard.ZstdCompressor(level=3).compress(data)) / len(data)

    def pieces(data):
        return [data[k : k + 4096] for k in range(0, len(data), 4096)] if len(data) >= 4096 else []

    known = {k: counts(t) for k, t in texts.items()}
    failed = {k for k, c in known.items() if c[0] < 50 or 2 * c[4] > c[0]}
    clean = [texts[k].encode() for k, good in labels.items() if good == 1 and k in texts and k not in failed]
    bands = quality.bands_of(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    full = sorted(int(ratio(p) * 10_000) for d in clean for p in pieces(d) if len(p) == 4096)
    if len(full) >= quality.PIECES:
        assert bands.chunk == tuple(full[int(q * (len(full) - 1))] / 10_000 + more for q, more in ((0.005, 0), (0.995, 1e-4)))
    bounds = [b[0] for b in bands.whole]
    own = [p for d in clean for p in [d, *pieces(d)] if p is d or len(p) < 4096]
    tight = 0
    for (low, *band), high in zip(bands.whole, [*bounds[1:], 10**12]):
        rates = sorted(int(ratio(p) * 10_000) for p in own if low <= len(p) < high)
        if len(rates) >= quality.PIECES:
            tight += 1
            assert band == [rates[int(q * (len(rates) - 1))] / 10_000 + more for q, more in ((0.005, 0), (0.995, 1e-4))]

    def good(data):
        def outside(piece):
            low, high = bands.chunk if len(piece) == 4096 and piece is not data else next(b[1:] for b in reversed(bands.whole) if b[0] <= len(piece))
            return not low <= ratio(piece) <= high

        return not outside(data) and sum(len(p) for p in pieces(data) if outside(p)) <= 0.25 * len(data)

    rows = entry.op6_compression_bands(spark, folder).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == known[r.doc_id]
        assert r.base_failed == (r.doc_id in failed) and r.kept == (not r.base_failed and good(texts[r.doc_id].encode()))
    assert any(not r.kept and not r.base_failed for r in rows) and sum(r.kept for r in rows) > 0.75 * (len(rows) - len(failed))


def test_quality_beside_clashing_names(spark):
    text = " ".join(f"w{k * k % 97}x{k}" for k in range(200))
    names = ["_kept", "kept", "KEPT", "quality_scores", "base_failed", "_id", "_quality", "label_id", "a.b"]
    docs = spark.createDataFrame([(1, text, *names[1:2], *names[3:]), (2, "few", *names[1:2], *names[3:])], ["doc_id", "text", "kept", *names[3:]])
    assert [tuple(r)[2:] for r in quality.keep_good(docs).collect()] == [("kept", *names[3:])]
    assert {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()} == {1: True, 2: False}
    assert quality.learned_bands(docs, spark.createDataFrame([(1, 1, 0)], "doc_id int, quality int, toxic int")) is not None


def test_counts_of_a_piece_model(spark):
    """A sentencepiece model: whole texts and long ones that are split."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [t for t in ODD if t is not None] + ["the  cat\nsat on a mat , \t and </s> ran " * 40, " lead", "end "]
    library = token_counts.load_tokenizer(path)
    want = [len(library.encode(t)) for t in texts]
    assert token_counts.splits_at_spaces(path)
    for limit in (3, 50, 32_768):
        assert token_counts.token_lengths(texts, path, limit).tolist() == want
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    assert [r.n_tokens for r in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()] == want


def test_learned_bands_reject_texts_unlike_the_clean_ones(spark):
    rng = np.random.default_rng(2)
    pool = ["".join(rng.choice(list("abcdefghijklmnopqrstuvw"), rng.integers(2, 9))) for _ in range(2000)]
    rows = [(k, " ".join(rng.choice(pool[: 400 if k % 5 == 0 else 2000], rng.integers(100, 900)))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(0, 1500, 2)] + [(None, 1, 0), (5, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    bands = quality.learned_bands(docs, labels)
    kept = {r.doc_id for r in quality.judge_quality(docs, bands).where("kept").collect()}
    unlike = {k for k, _ in rows if k % 5 == 0}
    assert len(kept & unlike) < 0.1 * len(unlike) and len(kept - unlike) > 0.93 * (len(rows) - len(unlike))
    assert all(quality.judge_quality(docs).select("kept").toPandas().kept)
    assert quality.learned_bands(docs, labels.limit(0)).chunk == quality.Bands().chunk


def many_clean_texts(spark):
    """22,000 texts: the last 2,000 by a hash of the id are less even than the others."""
    rng = np.random.default_rng(4)
    ids = [r.id for r in spark.range(22_000).orderBy(F.xxhash64("id"), "id").collect()]
    even, uneven = (["".join(rng.choice(list(letters), 5)) for _ in range(1000)] for letters in ("abcd", "abcdefghijklmnopqrstuvwxyz"))
    return [(k, " ".join(rng.choice(even if at < 20_000 else uneven, 60))) for at, k in enumerate(ids)], set(ids[20_000:])


def test_learned_bands_count_every_clean_label(spark):
    rows, _ = many_clean_texts(spark)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    bands = quality.learned_bands(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    sizes = {len(text) for _, text in rows}
    assert len(sizes) == 1
    compressor = quality.zstandard.ZstdCompressor(level=3)
    rates = sorted(int(len(compressor.compress(text.encode())) / len(text) * 10_000) for _, text in rows)
    band = next(b[1:] for b in reversed(bands.whole) if b[0] <= max(sizes))
    assert band == tuple(rates[int(q * (len(rates) - 1))] / 10_000 + more for q, more in ((0.005, 0), (0.995, 1e-4)))


def test_pipeline_keeps_texts_like_any_of_the_clean_ones(spark, tmp_path):
    """The pipeline's quality stage: clean texts beyond 20,000 labels are no outliers."""
    rows, last = many_clean_texts(spark)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert len(kept & last) > 0.9 * len(last) and len(kept) > 0.98 * len(rows)


def test_the_rest_after_full_chunks_is_judged():
    rng = np.random.default_rng(3)
    good = "".join(rng.choice(list("abcdefghijklmnopqrst "), 4096))
    verdict = quality.in_bands((good + "ab cd " * 650).encode(), quality.Bands(), quality.zstandard.ZstdCompressor())
    assert 0.16 < verdict[0] < 0.75 and verdict[1:] == (2, 1, False)
