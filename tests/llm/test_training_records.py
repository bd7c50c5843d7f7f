"""Hard negatives, record files and fill-in-middle against brute force."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudframe.llm import entry, fim, hard_negatives, records

DATA = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "é" * 50, "it's <|endoftext|> here", "x" * 5000, "word " * 3000, "tab\tand\r\n  spaces   ", "日本語 の\x0bテキスト 😀", "$$$ ### 123.45",
       "ends in space ", "a <S> b", "<P", "x <M", "\x1c\x1d odd \x85\xa0 gaps", "İstanbul ΣΑΣ Σ. é ŉ", "́ mark", "don'T'S 'Re"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "keep", 7) for k, t in enumerate(ODD + ODD[-2:])] + [(None, "no id here", "keep", 7), (None, None, None, None), (3, "a second row of id three", "x", 1), (3, "a second row of id three", "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fim string, n int").repartition(3)


# Fill-in-middle


def slow_fim(doc_id, text):
    text = text or ""
    tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_runs_of_texts(monkeypatch):
    monkeypatch.setattr(fim, "RUN_BYTES", 10)
    for sizes in ([], [0, 0], [3, 3, 3, 3, 3, 40, 1, 0, 2, 30], [100]):
        found = fim.runs(pa.array(["x" * n for n in sizes], pa.string()))
        assert [k for at, n in found for k in range(at, at + n)] == list(range(len(sizes)))
        assert all(sum(sizes[at : at + n - 1]) <= 10 for at, n in found)


def test_fill_in_middle_of_odd_texts(spark, odd):
    docs = odd.unionByName(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "fim", "n")).unionByName(odd.select((F.col("doc_id") * 77 + 5).alias("doc_id"), "text", "fim", "n"))
    done = fim.fill_in_middle(docs)
    assert done.columns == ["doc_id", "text", "n", "fim"]
    rows = done.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output) == slow_fim(r.doc_id, r.text)
        assert r.back == (r.text or "") and (r.text is None or r.n == 7 or r.n == 1)
    assert {r.fim.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entry.op13_fill_in_middle(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        *counts, output = slow_fim(r.doc_id, docs[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == counts
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t\x0b<PSM>é😀\x1c"), max_size=30), max_size=6), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 2))
def test_cuts_of_a_batch(texts, first, second, skip):
    sliced = pa.array(["skipped"] * skip + texts, pa.string()).slice(skip)
    forms = pa.array([("spm", "psm", "plain")[k % 3] for k in range(len(texts))], pa.string())
    got = fim.cut_batch(sliced, pa.array([first] * len(texts), pa.int64()), pa.array([second] * len(texts), pa.int64()), forms).to_pylist()
    for text, form, row in zip(texts, forms.to_pylist(), got, strict=True):
        tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
        n = len(tokens)
        a, b = sorted((first % (n + 1), second % (n + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        want = {"plain": (None, None, text), "spm": (len(p), len(m), f"<S>{s}<P>{p}<M>{m}"), "psm": (len(p), len(m), f"<P>{p}<S>{s}<M>{m}")}[form]
        assert (row["n"], row["prefix_chars"], row["middle_chars"], row["output"]) == (n, *want)


# Record files


def slow_checksum(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=5), st.sampled_from(["<u2", "<u4"]), st.integers(0, 100))
def test_checksums(counts, kind, seed):
    counts = np.array(counts, np.int64)
    ids = np.random.default_rng(seed).integers(0, 60_000, counts.sum()).astype(kind)
    got = records.checksums(ids, counts * ids.dtype.itemsize)
    assert got.tolist() == [slow_checksum(ids[e - n : e].tobytes()) for e, n in zip(np.cumsum(counts), counts, strict=True)]


def test_checksum_of_the_standard():
    crc = records.checksums(np.frombuffer(b"12345678", "<u4"), np.array([8]))[0]
    assert int(crc) == slow_checksum(b"12345678")
    plain = (int(crc) - 0xA282EAD8) & 0xFFFFFFFF
    assert (plain >> 17 | plain << 15) & 0xFFFFFFFF == 0x6087809A  # CRC-32C of 12345678


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBz 's\n\t.,9éİΣ😀́\x1c<|>\x85ŉ"), max_size=40) | st.text(max_size=60), max_size=5))
def test_words_encode_as_whole_texts(texts):
    library = records.load_tokenizer(WORDS)
    ids, counts = records.word_encoder(WORDS).encode(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_words_are_learned_anew_when_too_many():
    encoder, library = records.WordEncoder(WORDS, limit=3), Tokenizer.from_file(WORDS)
    for text in ("one two three four five", "six seven one", None, "one two"):
        ids, counts = encoder.encode(pa.array([text], pa.string()))
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids and counts.sum() == len(ids)
    assert not records.word_splits(BYTES) and records.word_splits(WORDS)


@pytest.mark.parametrize("tokenizer", [WORDS, BYTES])
def test_record_files_of_odd_texts(spark, odd, tokenizer, monkeypatch):
    monkeypatch.setattr(records, "IO_BYTES", 3000)
    library = Tokenizer.from_file(tokenizer)
    files = records.write_records(odd, tokenizer, end_id=2)
    index = records.with_start(files.index(spark))
    rows = records.read_records(files, records.in_order(files, index)).collect()
    want = sorted(((-1 if r.doc_id is None else r.doc_id), [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
    start, last = 0, -1
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and (r.doc_id is None or r.doc_id >= last)
        start, last = start + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    again = records.read_records(files, records.shuffled(files, index, 5)).collect()
    assert sorted((r.start, r.ids) for r in again) == sorted((r.start, r.ids) for r in rows) and [r.start for r in again] != [r.start for r in rows]
    # The bytes, by the format's own rules.
    store, folder = files.open()
    for name in {r.file for r in rows}:
        data, at = store.open_input_file(f"{folder}/{name}").read(), 0
        for r in sorted((r for r in rows if r.file == name), key=lambda r: r.record):
            (size,), (check,) = struct.unpack("<Q", data[at : at + 8]), struct.unpack("<I", data[at + 8 : at + 12])
            payload = data[at + 12 : at + 12 + size]
            assert r.offset == at + 12 and check == slow_checksum(data[at : at + 8]) and struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0] == slow_checksum(payload)
            assert np.frombuffer(payload, f"<u{files.id_bytes}").tolist() == r.ids
            at += size + 16
        assert at == len(data)


def test_damage_is_noticed_and_stray_files_go(spark, odd):
    files = records.write_records(odd, WORDS, end_id=2)
    store, folder = files.open()
    with store.open_output_stream(f"{folder}/000000-stray.rec") as f:
        f.write(b"left by a lost task")
    records.sweep(spark, files)
    names = [x.base_name for x in store.get_file_info(records.fs.FileSelector(folder)) if x.base_name.endswith(".rec")]
    assert names and "000000-stray.rec" not in names
    row = files.index(spark).orderBy(F.desc("n_tokens")).first()
    data = bytearray(store.open_input_file(f"{folder}/{row.file}").read())
    data[row.offset] ^= 1
    with store.open_output_stream(f"{folder}/{row.file}") as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="checksum is wrong"):
        records.read_records(files, files.index(spark)).collect()


def test_record_files_of_no_rows(spark, odd):
    files = records.write_records(odd.limit(0), WORDS, end_id=2)
    index = records.with_start(files.index(spark))
    assert records.read_records(files, records.in_order(files, index)).count() == 0


def test_record_files_query(spark):
    library = Tokenizer.from_file(WORDS)
    rows = {r.doc_id: r for r in entry.op12_record_files(spark, DATA).collect()}
    start = 0
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[r.doc_id].start, rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == 200


# Hard negatives


def slow_negatives(rows, is_anchor, label, k=5):
    """rows: (id, vector, label). All pairs, in plain Python."""
    used = [(i, [int(np.floor(256 * float(x))) for x in v], label(i, y)) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    sizes = defaultdict(int)
    for _, v, _ in used:
        sizes[len(v)] += 1
    dim = max(sizes, key=lambda d: (sizes[d], d), default=0)
    used = [u for u in used if len(u[1]) == dim]
    out = []
    for a, (anchor, v, y) in enumerate(used):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for b, (i, w, z) in enumerate(used) if b != a)
        for minus, positive, _ in [s for s in scored if s[2] == y][:k]:
            window = [s for s in scored if s[2] != y and -80 * minus <= -100 * s[0] <= -100 * minus][:k]
            out += [(anchor, positive, rank, i, -minus, -m) for rank, (m, i, _) in enumerate(window, 1)]
    return sorted(out)


RELABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def relabel(i, y):
    return (y + 1) % 10 if i % 7 == 0 else y


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    r = np.random.default_rng(3)
    rows = [(k, [round(float(x), 2) for x in r.normal(size=8)], int(r.integers(3))) for k in range(230)]
    rows += [(500 + k, rows[7][1], k % 2) for k in range(60)]  # one vector many times, in two labels
    rows += [(300, rows[0][1], 1), (300, rows[0][1], 1), (300, rows[3][1], 2), (10, rows[10][1], 0)]  # ids that come again
    rows += [(310, None, 1), (311, rows[0][1], None), (None, rows[0][1], 1), (312, [None] * 8, 1), (313, [float("nan")] * 8, 1), (314, [float("inf")] * 8, 1), (315, [1.0], 1), (316, [0.0] * 8, 1), (320, [], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"row": F.lit(1), "score": F.lit("x"), "bucket": F.lit(2)}).repartition(4)
    want = slow_negatives(rows, lambda i: i % 10 == 0, relabel)
    assert got(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.expr(RELABEL))) == want and len(want) > 200
    large = [(i, None if v is None else [x if x is None else x * 3e4 for x in v], y) for i, v, y in rows]
    df = spark.createDataFrame(large, "vec_id bigint, embedding array<double>, label int")
    assert got(hard_negatives.mine(df, F.col("vec_id") % 10 == 0)) == slow_negatives(large, lambda i: i % 10 == 0, lambda i, y: y)


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema), F.col("vec_id") % 10 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], schema)
    assert got(hard_negatives.mine(two, F.col("vec_id") % 10 == 0)) == [(0, 1, 1, 2, 65536, 58880)]
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(0, [3e8], 1)], schema), F.col("vec_id") % 10 == 0)


def test_hard_negatives_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert got(entry.op11_hard_negatives(spark, DATA)) == slow_negatives(rows, lambda i: i % 100 == 0, relabel)
