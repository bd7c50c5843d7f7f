"""Packing documents into training windows by the sum-of-squares rule.

Documents come online. Each is cut into full windows and a rest; the rest goes, whole, to
the fill level for which the sum over levels of (number of partially filled windows at that
level) squared becomes least. The counts are kept in an array indexed by level. When one
window too many is open, the fullest is filled up and closed: by the largest open window that
fits, and where none fits by ids cut from the emptiest. The same closes the windows at the end
of a partition; the last tokens, less than a window, go to windows of a power of two, so that
nothing is padded.

Every partition packs its own documents: memory is bounded by max_open windows, and a lost
task is simply run again. A sequence never spans partitions.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.shared import bound_arrow_batches
from cloudframe.llm.token_counts import load_tokenizer, safe_pieces

WINDOW = 1024
END_ID = 0
MAX_OPEN = 2048
ENCODE_CHARS = 262_144


@functools.lru_cache(maxsize=2)
def load_encoding(ranks_path: str):
    """The byte-level BPE of byte_bpe_50k.json by a faster library that gives the same ids.

    tiktoken merges the same vocabulary about four times as fast as tokenizers, which alone
    would take more than this operator's CPU budget. Tests hold the ids of both libraries
    against each other. The special string is its own id inside texts, as tokenizers does.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def encode(text: str | None, ranks_path: str, tokenizer_path: str, end_id: int = END_ID) -> np.ndarray:
    """The ids of a text, unsigned 32-bit little-endian, then end_id. Null: empty.

    A piece that the faster library refuses, as one of a million spaces on end, is encoded by
    tokenizers.
    """
    encoding, parts = load_encoding(ranks_path), []
    for piece in safe_pieces(text or "", ENCODE_CHARS):
        try:
            parts.append(encoding.encode(piece, allowed_special="all"))
        except ValueError:
            parts.append(load_tokenizer(tokenizer_path).encode(piece, add_special_tokens=False).ids)
    return np.concatenate([*(np.array(part, "<u4") for part in parts), np.array([end_id], "<u4")])


class SquaresPacker:
    """Packs pieces (doc, start, ids, doc_tokens) and yields rows with their sequence and offset.

    `closed` counts sequences by what closed them: full (a document's full window), squares,
    filled (from other windows) and last (of a power of two).
    """

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first_sequence: int = 0) -> None:
        self.window, self.max_open, self.next_sequence = window, max_open, first_sequence
        self.counts = np.zeros(window + 1, dtype=np.int64)  # the level array; 0 and window stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.n_open = self.n_tokens = 0
        self.closed: Counter = Counter()

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        n, at = len(ids), 0
        while n - at >= self.window:
            yield from self.close([(doc, at, ids[at : at + self.window], n)], "full")
            at += self.window
        if at < n:
            yield from self.place((doc, at, ids[at:], n))

    def place(self, piece: tuple) -> Iterator[tuple]:
        size, n = len(piece[2]), self.counts
        # Half the change of the sum of squares by moving a window from level h to h + size; h = 0 opens one.
        levels = np.arange(self.window - size + 1)
        gain = n[levels + size] - n[levels] + 1.0
        gain[0] = n[size] + 0.5
        gain[-1] = 0.5 - n[self.window - size] if size < self.window else gain[-1]
        gain[1:][n[1 : self.window - size + 1] == 0] = np.inf
        level = int(gain.argmin())
        pieces = [*(self.take(level) if level else ()), piece]
        if level + size == self.window:
            yield from self.close(pieces, "squares")
            return
        self.put(level + size, pieces)
        if self.n_open > self.max_open and self.n_tokens >= self.window:
            yield from self.fill()

    def take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.n_open -= 1
        self.n_tokens -= level
        return self.open[level].pop()

    def put(self, level: int, pieces: list[tuple]) -> None:
        self.open[level].append(pieces)
        self.counts[level] += 1
        self.n_open += 1
        self.n_tokens += level

    def fill(self) -> Iterator[tuple]:
        """Fill up the fullest window from others and close it; the open ones must hold a window's tokens at least."""
        level = int(np.flatnonzero(self.counts)[-1])
        pieces = self.take(level)
        while level < self.window:
            fitting = np.flatnonzero(self.counts[: self.window - level + 1])
            if len(fitting):
                pieces += self.take(int(fitting[-1]))
                level += int(fitting[-1])
                continue
            least = int(np.flatnonzero(self.counts)[0])
            given, kept = self.cut(self.take(least), self.window - level)
            self.put(least - (self.window - level), kept)
            pieces, level = pieces + given, self.window
        yield from self.close(pieces, "filled")

    @staticmethod
    def cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
        """The first `size` ids of some pieces, and the pieces left."""
        given, left = [], pieces[::-1]
        while size:
            doc, start, ids, n = left.pop()
            if len(ids) > size:
                left.append((doc, start + size, ids[size:], n))
                ids = ids[:size]
            given.append((doc, start, ids, n))
            size -= len(ids)
        return given, left[::-1]

    def finish(self) -> Iterator[tuple]:
        """Close all windows that are open."""
        while self.n_tokens >= self.window:
            yield from self.fill()
        total = self.n_tokens
        left = [p for level in np.flatnonzero(self.counts)[::-1] for _ in range(self.counts[level]) for p in self.take(int(level))]
        for size in (1 << k for k in reversed(range(self.window.bit_length())) if total >> k & 1):
            pieces, left = self.cut(left, size)
            yield from self.close(pieces, "last")

    def close(self, pieces: list[tuple], why: str) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, n in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next_sequence, offset, ids
            offset += len(ids)
        self.next_sequence += 1
        self.closed[why] += 1


def pack_documents(docs: DataFrame, ranks_path: str, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, max_open: int = MAX_OPEN) -> DataFrame:
    """One row for each piece of a document in a sequence.

    ranks_path and tokenizer_path are files of one vocabulary, for tiktoken and tokenizers.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    token_ids (array<int>) if with_ids. A document's ids are those of its text (null: none)
    and end_id; every id lies in exactly one piece. sequence_id is the partition's number
    times 2^32 plus a running number. window must be a power of two. Other columns of docs
    are left behind; rows that are equal are packed each for itself.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    bound_arrow_batches(docs.sparkSession)
    ids_type = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {ids_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", token_ids array<int>" * with_ids

    def rows_to_batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], doc_type)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            lengths = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(columns[7]).astype(np.int32))))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SquaresPacker(window, max_open, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.extend(packer.add(doc, encode(text, ranks_path, tokenizer_path, end_id)))
                if len(rows) >= 4096:
                    yield rows_to_batch(rows, doc_type)
                    rows = []
        rows.extend(packer.finish())
        for at in range(0, len(rows), 4096):
            yield rows_to_batch(rows[at : at + 4096], doc_type)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pack, schema)
