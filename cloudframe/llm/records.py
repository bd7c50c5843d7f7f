"""Token ids in files of length-delimited binary records, with an offset index for shuffled reads.

A record is its payload's length (8 bytes), that length's masked checksum (4), the payload, and
the payload's masked checksum (4), all little-endian. Checksums are CRC-32C. The payload is one
document's ids, 2 bytes each if the vocabulary allows that, else 4.

Documents are dealt out by ranges of their ids; each task encodes its range in order and writes
one file into the shared folder. What it returns is the index: one row a record, with the file
and the place in it. Spark commits the index as a table, and only files that it names count: a
task that is run again writes a file of its own, and what a lost one left behind is swept away.
"""

from __future__ import annotations

import atexit
import functools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudframe.llm.shared import bound_arrow_batches, broadcast_if_small, drop_path, shared_folder
from cloudframe.llm.token_counts import load_tokenizer

#: Fixed values of the record format: the reversed CRC-32C polynomial, what is added to mask a checksum.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
#: Bytes of text that one file gets, about; bytes of records written, or read, at once.
FILE_BYTES, IO_BYTES = 256 << 20, 8 << 20
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 800_000
#: Files at most whose first ids' places are broadcast.
MOST_FILES = 1_000_000


@functools.cache
def crc_tables() -> np.ndarray:
    """Table k gives what a byte followed by k zero bytes does to the checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    out = [table]
    for _ in range(3):
        out.append(table[out[-1] & 0xFF] ^ (out[-1] >> 8))
    return np.stack(out)


def _apply(matrix: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The product of a 32 x 32 bit matrix, as four tables of 256, and each state."""
    return matrix[0][state & 0xFF] ^ matrix[1][(state >> 8) & 0xFF] ^ matrix[2][(state >> 16) & 0xFF] ^ matrix[3][state >> 24]


@functools.cache
def _zeros(power: int) -> np.ndarray:
    """The matrix, as four tables, of 4 x 2^power zero bytes."""
    if power == 0:
        return crc_tables()[[3, 2, 1, 0]]
    half = _zeros(power - 1)
    return np.stack([_apply(half, half[k]) for k in range(4)])


#: Words of four bytes that are summed up one after the other; longer payloads are folded.
LANE = 64


def checksums(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of payloads that stand one after the other in `data` (whole numbers of 2 or 4 bytes), of so many bytes each.

    Payloads are cut from their ends into lanes of LANE words. All lanes go forward together, a
    word a step; then neighbouring lanes are folded into one until each payload has one. Zeros in
    front change nothing in a sum that starts at zero, so a first lane may be short; the usual
    start of all ones is put onto the payload's first four bytes instead.
    """
    sizes = np.asarray(sizes, np.int64)
    unit = data.dtype.itemsize
    counts, short = -(-sizes // 4), -sizes % 4
    odd = short > 0
    if odd.any():  # zeros in front, up to whole words
        data = np.insert(data, np.repeat(((np.cumsum(sizes) - sizes) // unit)[odd], short[odd] // unit), 0)
    words = np.ascontiguousarray(data).view("<u4").copy()
    ends = np.cumsum(counts)
    starts, filled = ends - counts, sizes > 0
    ones = np.uint64(0xFFFFFFFF)
    words[starts[filled]] ^= ((ones << (8 * short[filled]).astype(np.uint64)) & ones).astype(np.uint32)
    rest = filled & odd & (counts > 1)
    words[starts[rest] + 1] ^= (ones >> (32 - 8 * short[rest]).astype(np.uint64)).astype(np.uint32)
    lanes = -(-counts // LANE)
    owner = np.repeat(np.arange(len(counts)), lanes)
    back = np.repeat(np.cumsum(lanes), lanes) - np.arange(lanes.sum())  # 1 for a payload's last lane
    state, step = np.zeros(len(owner), np.uint32), _zeros(0)
    at, first = ends[owner] - back * LANE, starts[owner]
    for k in range(LANE if len(words) else 0):
        place = at + k
        state = _apply(step, state ^ np.where(place >= first, words[np.maximum(place, 0)], np.uint32(0)))
    power = LANE.bit_length() - 1
    while len(back) and back.max() > 1:
        # Lanes are paired from the payload's end; of an odd number the first stays alone.
        left = back % 2 == 0
        state[np.flatnonzero(left) + 1] ^= _apply(_zeros(power), state[left])
        state, owner, back, power = state[~left], owner[~left], (back[~left] + 1) // 2, power + 1
    crc = np.zeros(len(counts), np.uint32)
    crc[filled] = state
    tiny = sizes < 4  # what of the start the payload's bytes don't take up
    crc[tiny] ^= (ones >> (8 * sizes[tiny]).astype(np.uint64)).astype(np.uint32)
    crc ^= np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


#: Words of printable ASCII and the letters of Latin-1, and the words into which the tokenizer's pattern, a fixed value, cuts them.
COMMON = re.compile("[\\x21-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,64}").fullmatch
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", re.IGNORECASE | re.ASCII)


class WordEncoder:
    """The ids of whole texts from the tokenizers library, which encodes each distinct word once.

    Words are what stands between ASCII white space. word_splits() looks whether a tokenizer
    drops white space and encodes words alone as within a text; if not, it encodes texts whole.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        self.tokenizer, self.limit = load_tokenizer(path), limit
        self.split = word_splits(path)
        self.end_of_word = np.array([t is not None and t.endswith("</w>") for t in map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))])
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 10, np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode words: those of common characters in one string together, as it is known how many words of the tokenizer each has."""
        common = [w for w in words if COMMON(w) and "<|" not in w]
        many = np.array([len(SPLIT.findall(w)) for w in common], np.int64)
        ids = np.array(self._encode([" ".join(common)])[0], np.uint32) if common else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.end_of_word[ids]) + 1
        if len(ends) != many.sum():  # a tokenizer of another pattern
            common, ids, ends, many = [], ids[:0], ends[:0], many[:0]
        ends = ends[np.cumsum(many) - 1]
        known = set(common)
        others = [w for w in words if w not in known]
        encoded = self._encode(others) if others else []
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(e) for e in encoded], np.int64)])
        ids = np.concatenate([ids, *(np.array(e, np.uint32) for e in encoded)])
        n, start = len(self.rows), self.ends[len(self.rows)]
        while n + len(lengths) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[start : start + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(lengths)] = start + np.cumsum(lengths)
        self.rows.update(zip([*common, *others], range(n, n + len(lengths)), strict=True))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; null texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.split:
            found = [np.array(e, np.uint32) for e in self._encode(texts.to_pylist())]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(e) for e in found], np.int64)
        words = pc.ascii_split_whitespace(texts)
        of_text = pc.list_value_length(words).to_numpy()
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        if len(self.rows) > self.limit:
            self.forget()
        new = [w for w in distinct if w not in self.rows]
        if new:
            self.learn(new)
        row = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))
        known = pa.ListArray.from_arrays(pa.array(self.ends[: len(self.rows) + 1]), pa.array(self.ids[: self.ends[len(self.rows)]]))
        lists = known.take(pa.array(row[coded.indices.to_numpy()]))
        upto = lists.offsets.to_numpy()
        return lists.flatten().to_numpy(), np.diff(upto[np.concatenate([[0], np.cumsum(of_text)])]).astype(np.int64)


@functools.lru_cache(maxsize=2)
def word_splits(path: str) -> bool:
    """Whether a tokenizer gives the same ids for words apart as with white space between them."""
    encode = lambda t: load_tokenizer(path).encode(t, add_special_tokens=False).ids
    words = ["The", "end's", "1,", "Z̈u", "<|endoftext|>x", "ΣαΣ", "́", "a b", "\x1c", "'s", "..."]
    together = [i for w in words for i in encode(w)]
    return all(encode(gap.join(words)) == together for gap in (" ", "\n", "\t \r\n", "\x0b", "\x0c  "))


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


INDEX = "doc_id bigint, file string, file_number int, record bigint, start_in_file bigint, offset bigint, n_tokens bigint"


@dataclass(frozen=True)
class RecordFiles:
    """A folder of record files, and how many bytes an id has in them."""

    path: str
    id_bytes: int

    def index(self, spark) -> DataFrame:
        """One row a record: doc_id, file, file_number (in order of doc_id), record, start_in_file (ids before it), offset (of its payload), n_tokens."""
        return spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def open(self) -> tuple[fs.FileSystem, str]:
        """The file system and the folder in it, in a task or on the driver."""
        return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", self.path))


def framed(ids: np.ndarray, counts: np.ndarray) -> tuple[list[memoryview], np.ndarray]:
    """The bytes of records in parts, and where each record's payload begins among them. ids have the width of the files."""
    sizes = counts * ids.dtype.itemsize
    lengths = np.stack([sizes, np.zeros_like(sizes)], axis=1).astype("<u4").ravel()
    head = np.concatenate([lengths.reshape(-1, 2), checksums(lengths, np.full(len(sizes), 8)).astype("<u4")[:, None]], axis=1)
    heads, body, tails = memoryview(head.tobytes()), memoryview(ids.tobytes()), memoryview(checksums(ids, sizes).astype("<u4").tobytes())
    parts, ends = [], np.cumsum(sizes).tolist()
    for k, (end, size) in enumerate(zip(ends, sizes.tolist(), strict=True)):
        parts += (heads[12 * k : 12 * k + 12], body[end - size : end], tails[4 * k : 4 * k + 4])
    return parts, np.cumsum(sizes + 16) - sizes - 4


def pieces(text: str, limit: int = IO_BYTES) -> Iterator[str]:
    """Cut a very long text at spaces, which no word of WordEncoder holds."""
    start = 0
    while len(text) - start > limit and (cut := text.find(" ", start + limit)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


def encoded(encoder: WordEncoder, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of texts, each with end_id after it, and how many each has: some texts at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    group = np.cumsum(sizes) // IO_BYTES
    for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
        some = texts.slice(at[0], len(at)) if len(at) else texts
        if len(at) == 1 and sizes[at[0]] > IO_BYTES and encoder.split:
            parts = [encoder.encode(pa.array([p]))[0] for p in pieces(some[0].as_py())]
            ids, counts = np.concatenate(parts), np.array([sum(map(len, parts))])
        else:
            ids, counts = encoder.encode(some)
        yield np.insert(ids, np.cumsum(counts), end_id), counts + 1


def write_records(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> RecordFiles:
    """Encode every text, null as empty, with end_id after it, and write the ids in ascending order of the id column.

    Null ids come first; rows of equal ids all have records, in any order. Ids are cast to
    bigint. Files get some FILE_BYTES of text each, by ranges of (id, row), so that many rows
    of one id, or of none, are several files too. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    id_bytes = 2 if max(load_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    files = RecordFiles(f"{shared_folder(spark)}/records-{uuid.uuid4().hex}", id_bytes)
    atexit.register(drop_path, spark, files.path)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(1, -(-size // FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 20))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "at").sortWithinPartitions(F.asc_nulls_first("doc_id"), "at")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files.open()
        store.create_dir(folder, recursive=True)
        number, encoder = TaskContext.get().partitionId(), word_encoder(tokenizer)
        name, out = f"{number:06d}-{uuid.uuid4().hex}.rec", None
        record = start = offset = 0
        for batch in batches:
            row = 0
            for ids, counts in encoded(encoder, batch.column(1), end_id) if batch.num_rows else ():
                out = out or store.open_output_stream(f"{folder}/{name}")
                parts, begins = framed(ids.astype(f"<u{id_bytes}"), counts)
                data = b"".join(parts)
                out.write(data)
                n, before = len(counts), start + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array([name] * n), pa.array(np.full(n, number, np.int32)), pa.array(record + np.arange(n)), pa.array(before), pa.array(offset + begins), pa.array(counts)], [c.split()[0] for c in INDEX.split(", ")])
                record, start, offset, row = record + n, int(before[-1] + counts[-1]), offset + len(data), row + n
        if out:
            out.close()

    dealt.select("doc_id", "text").mapInArrow(write, INDEX).write.parquet(f"{files.path}/index")
    sweep(spark, files)
    return files


def sweep(spark, files: RecordFiles) -> None:
    """Delete record files that the index doesn't name: those of tasks that were lost or run twice."""
    named = {r["file"] for r in files.index(spark).select("file").distinct().collect()}
    store, folder = files.open()
    for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if found.base_name.endswith(".rec") and found.base_name not in named:
            store.delete_file(found.path)


def read_records(files: RecordFiles, rows: DataFrame, digest: bool = False) -> DataFrame:
    """rows (of the index, in any order, as after a shuffle) with what their records hold: ids, or for digest their ids_crc32.

    Records that follow each other are read at once. Lengths and checksums are verified. Rows
    come out in the order in which they come in.
    """
    bound_arrow_batches(rows.sparkSession)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files.open()
        name, source = None, None
        for batch in batches:
            column = dict(zip(names, batch.columns, strict=True))
            file, offset, size = column["file"].to_pylist(), column["offset"].to_numpy(), column["n_tokens"].to_numpy() * files.id_bytes
            begin = 0
            while begin < batch.num_rows:
                end = begin + 1
                while end < batch.num_rows and file[end] == file[begin] and offset[end] == offset[end - 1] + size[end - 1] + 16 and offset[end] + size[end] - offset[begin] <= IO_BYTES:
                    end += 1
                if file[begin] != name:
                    name, source = file[begin], store.open_input_file(f"{folder}/{file[begin]}")
                found, ids = unframed(source.read_at(int(offset[end - 1] + size[end - 1] - offset[begin]) + 16, int(offset[begin]) - 12), size[begin:end], files.id_bytes)
                if digest:
                    last = pa.array([zlib.crc32(ids[e - n : e]) for n, e in zip(found.tolist(), np.cumsum(found).tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns), last], schema.names)
                begin = end

    return rows.mapInArrow(read, schema)


def unframed(data: bytes, sizes: np.ndarray, id_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each of some records has that follow each other in data, and all their ids (4 bytes each).

    A record whose length isn't the one expected, or that a checksum refuses, is an error.
    """
    view, begins = memoryview(data), (np.cumsum(sizes + 16) - sizes - 4).tolist()
    ends = [b + n for b, n in zip(begins, sizes.tolist(), strict=True)]
    heads = np.frombuffer(b"".join([view[b - 12 : b] for b in begins]), "<u4").reshape(-1, 3)
    tails = np.frombuffer(b"".join([view[e : e + 4] for e in ends]), "<u4")
    ids = np.frombuffer(b"".join([view[b:e] for b, e in zip(begins, ends, strict=True)]), f"<u{id_bytes}")
    lengths = np.ascontiguousarray(heads[:, :2]).ravel()
    whole = (heads[:, 1] == 0) & (heads[:, 0] == sizes) & (heads[:, 2] == checksums(lengths, np.full(len(sizes), 8)))
    if not whole.all() or (tails != checksums(ids, sizes)).any():
        raise ValueError("a record's length or checksum is wrong")
    return sizes // id_bytes, ids.astype("<u4")


def in_order(files: RecordFiles, index: DataFrame) -> DataFrame:
    """The index in order of file and record, in as many parts as there are files: a record's number says how it is dealt out."""
    n = max(1, index.agg(F.count_distinct("file_number")).first()[0])
    return index.repartitionByRange(n, "file_number", "record").sortWithinPartitions("file_number", "record")


def shuffled(files: RecordFiles, index: DataFrame, seed: int) -> DataFrame:
    """The index in an order that follows from the seed, for reading an epoch's records at random."""
    return index.orderBy(F.xxhash64(F.lit(seed), "file_number", "record"), "file_number", "record")


def with_start(index: DataFrame) -> DataFrame:
    """Add `start`: ids of all records before, in order of file and record. Only the files' sums are put in order."""
    sums = index.groupBy("file_number").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file_number", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return index.join(broadcast_if_small(bases, MOST_FILES), "file_number").withColumn("start", F.col("base") + F.col("start_in_file")).drop("base")
