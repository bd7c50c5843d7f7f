"""Quality rules: bands of zstandard ratios over whole documents and fixed chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.llm.shared import bound_arrow_batches, own_columns, unused

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Learned limits hold from one of these lengths in bytes to the next, a fourth of an octave on.
STEPS = (0, *(int(np.ceil(2 ** (k / 4))) for k in range(16, 97)))
#: The step of full chunks; pieces that a limit needs; the share of clean pieces left out on each side.
FULL, PIECES, TAIL = -1, 100, 0.005


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / original bytes. These are for texts without labels; learned_bands() sets narrow ones.

    whole: (bytes from which on, least ratio, greatest ratio), by length. Short texts pay
    for zstandard's frame and cannot repeat much, so their band is wide. Prose stays below
    0.55 from 1024 bytes on; random letters have 0.75 and more, random characters of several
    bytes 0.72 and more.
    chunk_bytes: size of the fixed chunks; chunk: the band of each full chunk; the rest after
    them has the band in whole of its own length. A document fails if chunks outside their
    bands hold more than bad_chunks of its bytes.
    """

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (256, 0.25, 0.90), (1024, 0.20, 0.75), (4096, 0.16, 0.70), (16384, 0.12, 0.65))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.16, 0.70)
    bad_chunks: float = 0.25
    level: int = 3


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    repeated = end = 0
    if len(found) < len(windows):
        for at, window in enumerate(windows):
            if found[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def chunk_ratios(data: bytes, size: int, compressor: zstandard.ZstdCompressor) -> list[tuple[int, float]]:
    """(bytes, ratio) of each chunk, the rest at the end included; none of a text of less than a chunk, as the whole is judged anyway."""
    chunks = (data[at : at + size] for at in range(0, len(data), size)) if len(data) >= size else ()
    return [(len(c), len(compressor.compress(c)) / len(c)) for c in chunks]


def in_bands(data: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks, those outside their band, and the verdict."""
    if not data:
        return 0.0, 0, 0, True

    def of_length(n: int) -> tuple[float, float]:
        return bands.whole[bisect_right(bands.whole, n, key=lambda x: x[0]) - 1][1:]

    ratio = len(compressor.compress(data)) / len(data)
    low, high = of_length(len(data))
    chunks = chunk_ratios(data, bands.chunk_bytes, compressor)
    bad = [n for n, r in chunks if not (band := bands.chunk if n == bands.chunk_bytes else of_length(n))[0] <= r <= band[1]]
    return ratio, len(chunks), len(bad), low <= ratio <= high and sum(bad) <= bands.bad_chunks * len(data)


def learned_bands(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> Bands:
    """Bands whose limits are the quantiles TAIL and 1 - TAIL of the ratios of clean labelled documents.

    Clean are all documents labelled quality 1 that don't fail the base rules. Whole texts and
    rests after full chunks set the limits of their step of length, full chunks those of
    `chunk`. A step of few pieces borrows those of the next one or two on each side; if it has
    hardly any itself, the limits of `bands` stay. Pieces are measured before labels are
    joined to them, so no text is shuffled, however many labels there are. The driver gets
    counts by step and ratio, not texts.
    """
    bound_arrow_batches(docs.sparkSession)
    clean = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality")).where((F.col("quality") == 1) & F.col("label_id").isNotNull()).select("label_id")

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            pieces = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                n_words, _, _, _, repeated = base_counts(text)
                if n_words < 50 or 100 * repeated > 50 * n_words:
                    continue
                data = text.encode()
                found = [(len(data), len(compressor.compress(data)) / len(data), False)]
                found += [(n, r, n == bands.chunk_bytes) for n, r in chunk_ratios(data, bands.chunk_bytes, compressor)]
                pieces += [(row, FULL if full else bisect_right(STEPS, n) - 1, int(r * 10_000)) for n, r, full in found]
            rows, *columns = list(zip(*pieces, strict=True)) or [[], [], []]
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int32()) for c in columns)], ["id", "step", "ratio"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    measured = texts.mapInArrow(ratios, f"id {texts.schema['id'].dataType.simpleString()}, step int, ratio int")
    counts = measured.join(clean, F.col("id") == F.col("label_id")).groupBy("step", "ratio").count()
    found: dict[int, list[tuple[int, int]]] = {}
    for step, ratio, n in counts.collect():
        found.setdefault(step, []).append((ratio, n))

    def limits(steps: list[int], default: tuple[float, float]) -> tuple[float, float] | None:
        pooled = sorted(x for k in steps for x in found.get(k, []))
        upto = np.cumsum([n for _, n in pooled])
        if not pooled or upto[-1] < PIECES:
            return default if len(steps) > 4 or steps == [FULL] else None
        low, high = (pooled[int(np.searchsorted(upto, q * (upto[-1] - 1), "right"))][0] for q in (TAIL, 1 - TAIL))
        return low / 10_000, (high + 1) / 10_000

    whole = []
    for k, least in enumerate(STEPS):
        default = bands.whole[bisect_right(bands.whole, least, key=lambda x: x[0]) - 1][1:]
        enough = 4 * sum(n for _, n in found.get(k, [])) >= PIECES
        band = next(x for w in range(3) if (x := limits(list(range(k - w, k + w + 1)), default))) if enough else default
        whole.append((least, *band))
    return replace(bands, whole=tuple(whole), chunk=limits([FULL], bands.chunk))


def bands_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Bands:
    """The bands learned from the table labels of sf_dir, or the wide ones if there is no such table."""
    try:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Bands()
    return learned_bands(docs, labels)


SCORES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,zstd_ratio:double,n_chunks:bigint,n_bad_chunks:bigint,in_bands:boolean>"


def quality_scores(text: Column, bands: Bands = Bands()) -> Column:
    """A struct column with the counts and compression verdict of each whole text (null: empty)."""
    fields = [x.split(":")[0] for x in SCORES[7:-1].split(",")]
    types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]

    @F.arrow_udf(SCORES)
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            rows = [(*base_counts(t), *in_bands(t.encode(), bands, compressor)) for t in (x or "" for x in texts.to_pylist())]
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    return scores(text)


def judge_quality(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """Add a struct column `quality_scores`, base_failed and kept to every row; columns of these names are replaced.

    base_failed: fewer than 50 words, or more than half the words in repeated three-word
    windows. kept: not base_failed and within the compression bands. Null and empty texts
    have no words and so fail. Rows are independent; nothing is shuffled.
    """
    kept, names = _judged(docs, bands, text_col)
    return kept.select(*own_columns(docs, *VERDICT), *(F.col(n).alias(v) for n, v in zip(names, VERDICT, strict=True)))


VERDICT = ("quality_scores", "base_failed", "kept")


def _judged(docs: DataFrame, bands: Bands, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names, that none of its own has."""
    bound_arrow_batches(docs.sparkSession)
    names = unused(docs.columns, *VERDICT)
    scored = docs.withColumn(names[0], quality_scores(F.col(text_col), bands))
    n, r = F.col(f"{names[0]}.n_words"), F.col(f"{names[0]}.n_repeat_words")
    scored = scored.withColumn(names[1], (n < 50) | (100 * r > 50 * n))
    return scored.withColumn(names[2], ~F.col(names[1]) & F.col(f"{names[0]}.in_bands")), names


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows that judge_quality() keeps, with their own columns only."""
    judged, names = _judged(docs, bands, text_col)
    return judged.where(F.col(names[2])).select(*own_columns(docs))
