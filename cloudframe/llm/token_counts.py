"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.shared import bound_arrow_batches

#: Characters from which on a text is split, and bytes that one encode_batch call gets.
SPLIT_CHARS = 32_768
BATCH_BYTES = 262_144


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file, once for each Python worker: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def safe_pieces(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """Cut a long text where byte-level BPE has a boundary anyway.

    A cut goes just before a space or newline that follows a character other than white
    space: the pre-tokenizer starts a new word there whatever stands around it, and no
    special token holds a space. A stretch without such a place stays whole.
    """
    start, n = 0, len(text)
    while n - start > limit:
        cut = start + limit
        while cut < n and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    if start < n:
        yield text[start:]


def spaced_pieces(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """Cut a long text at single spaces between other characters, and drop those spaces.

    sentencepiece writes the start of a text as it writes a space, and its pieces begin at
    spaces, so the parts have the tokens of the whole. splits_at_spaces() looks whether a
    model does so. A stretch without such a space stays whole.
    """
    start, n = 0, len(text)
    while n - start > limit:
        cut = start + limit
        while cut < n and not (text[cut] == " " and not text[cut - 1].isspace() and cut + 1 < n and not text[cut + 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut + 1
    if start < n:
        yield text[start:]


@functools.lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether the sentencepiece model at `path` encodes words alone as it does between spaces."""
    encode = load_tokenizer(path).encode
    return all(encode(f"{a} {b}") == encode(a) + encode(b) for a, b in (("a", "b"), ("the", "end"), ("1,", "Zürich"), ("</s>", "\n")))


def token_lengths(texts: list[str | None], path: str, split_chars: int = SPLIT_CHARS, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Number of tokens of each text; null and empty texts have none."""
    tokenizer, out = load_tokenizer(path), np.zeros(len(texts), dtype=np.int64)
    is_json = path.endswith(".json")
    pieces = safe_pieces if is_json else spaced_pieces if splits_at_spaces(path) else lambda text, limit: (text,)
    rows: list[int] = []
    batch: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if is_json:
            lengths = [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        else:
            lengths = [len(ids) for ids in tokenizer.encode(batch, num_threads=1)]
        np.add.at(out, rows, lengths)
        rows.clear()
        batch.clear()
        size = 0

    for row, text in enumerate(texts):
        if text:
            for piece in pieces(text, split_chars):
                rows.append(row)
                batch.append(piece)
                size += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
                if size >= batch_bytes:
                    flush()
    if batch:
        flush()
    return out


def token_count(text: Column | str, path: str) -> Column:
    """A column with the number of tokens of `text` under the tokenizer file at `path`.

    No begin, end or added special tokens, no truncation, no padding; special strings
    inside a text are handled as the library does by default. Null and empty: 0.
    """

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(token_lengths(texts.to_pylist(), path), pa.int64())

    return lengths(F.col(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row.

    Rows of any number and length are independent: nothing is shuffled, and other columns
    never leave the JVM. Columns of these three names are replaced. Null text: 0, 0, false.
    """
    bound_arrow_batches(docs.sparkSession)
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text_col).cast("bigint"), F.lit(0).cast("bigint")))
        .withColumn("n_tokens", token_count(text_col, path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
