"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered in one pass over all training rows, in each task by language and bucket,
and summed by Spark. The log-probability matrix (languages x buckets, its size checked) is
broadcast; texts are scored in batches by gathering its rows and summing them by document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.shared import bound_arrow_batches, own_columns, unused

#: 2^BITS buckets for all orders together.
BITS = 15
ORDERS = (1, 2, 3)
#: The matrix that goes to every executor may have so many bytes; more languages are an error.
MAX_MODEL_BYTES = 64 << 20
#: Characters that are handled at once; a longer text is read as slices, each with the end of the one before.
SLICE = 262_144
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def tail(part: str) -> str:
    """The last characters of a part that n-grams may share with the next, runs of other characters than letters as one space."""
    out, at = "", len(part)
    while at and len(out) < max(ORDERS) - 1:
        at -= 1
        char = part[at] if part[at].isalpha() else " "
        if not (char == " " and out[:1] == " "):
            out = char + out
    return out


def slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Row numbers, texts of about SLICE characters together, and how many characters of each are of the slice before."""
    rows, parts, carried, size = [], [], [], 0
    for row, text in enumerate(texts):
        text, before = (text or "").lower(), ""
        for at in range(0, len(text), SLICE):
            carried.append(len(before))
            parts.append(before + text[at : at + SLICE])
            rows.append(row)
            before = tail(parts[-1])
            size += len(parts[-1])
            if size >= SLICE:
                yield rows, parts, carried
                rows, parts, carried, size = [], [], [], 0
    if rows:
        yield rows, parts, carried


def hashed_ngrams(parts: list[str], carried: list[int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(part number, bucket) of every n-gram, parts ascending within each order.

    Runs of other characters than letters count as one space; an n-gram of a space alone
    isn't counted, nor one within the first `carried` characters of a part.
    """
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    part = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    code = np.where(letters()[code], code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (part[1:] != part[:-1])
    code, part = code[keep], part[keep]
    new = np.arange(len(code)) >= (np.searchsorted(part, np.arange(len(parts))) + carried)[part]
    found_parts, found = [], []
    rolled = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        end = len(code) - n + 1
        if end <= 0:
            break
        rolled = (rolled[:end] * np.uint32(0x01000193)) ^ (code[n - 1 :] + np.uint32(n))
        if n in ORDERS:
            mixed = rolled * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            ok = (part[:end] == part[n - 1 :]) & new[n - 1 :]
            if n == 1:
                ok = ok & (code != 32)
            found.append((mixed >> np.uint32(32 - bits))[ok].astype(np.int32))
            found_parts.append(part[:end][ok])
    return (np.concatenate(found_parts), np.concatenate(found)) if found else (np.zeros(0, np.int32),) * 2


@dataclass(frozen=True)
class LanguageModel:
    """languages: names in order; weights: buckets x languages log-probabilities; priors: log shares of the documents."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows x languages, and for each row whether it has a letter."""
        out = np.tile(self.priors, (len(texts), 1))
        lettered = np.zeros(len(texts), bool)
        bits = int(self.weights.shape[0]).bit_length() - 1
        for rows, parts, carried in slices(texts):
            part, bucket = hashed_ngrams(parts, carried, bits)
            rows = np.array(rows)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
            if len(part):
                sums = np.add.reduceat(self.weights[bucket], starts, axis=0, dtype=np.float64)
                np.add.at(out, rows[part[starts]], sums)
                lettered[rows[part[starts]]] = True
        return out, lettered


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, alpha: float = 0.5) -> LanguageModel:
    """Learn from every row of train with a text and a language.

    Rows with null in either are left out; no rows at all give a model without languages,
    which answers "und" for everything. What is collected has one number for each language
    and bucket, within MAX_MODEL_BYTES: 512 languages at 2^15 buckets, beyond which it is a
    ValueError and fewer bits are needed.
    """
    bound_arrow_batches(train.sparkSession)
    train = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    shares = train.groupBy(F.col(lang_col).alias("lang")).count().limit(MAX_MODEL_BYTES // (4 << bits) + 1).toPandas().sort_values("lang")
    if len(shares) * (4 << bits) > MAX_MODEL_BYTES:
        raise ValueError(f"more than {MAX_MODEL_BYTES // (4 << bits)} languages; take fewer bits")
    index = {name: k for k, name in enumerate(shares["lang"])}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(index), 1 << bits), np.int64)
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for rows, parts, carried in slices(batch.column(0).to_pylist()):
                part, bucket = hashed_ngrams(parts, carried, bits)
                key = (langs[np.array(rows)][part] << bits) + bucket
                counts += np.bincount(key, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        for at in range(0, len(lang), 65_536):
            part = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(lang[part], pa.int32()), pa.array(bucket[part], pa.int32()), pa.array(counts[lang[part], bucket[part]], pa.int64())], ["lang", "bucket", "n"])

    counted = train.select(text_col, lang_col).mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(index), 1 << bits))
    counts[counted["lang"], counted["bucket"]] = counted["n"]
    weights = np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * (1 << bits)))
    priors = np.log(shares["count"].to_numpy(float) / max(1, shares["count"].sum()))
    return LanguageModel(tuple(index), np.ascontiguousarray(weights.T.astype(np.float32)), priors)


def predict(text: Column, model: LanguageModel, spark) -> Column:
    """A struct column lang_pred (string), score (double: the posterior probability of lang_pred, 0 for "und")."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in batches:
            texts = texts.to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model.languages and texts:
                out, lettered = model.log_likelihoods(texts)
                best = out.argmax(axis=1)
                scores = np.where(lettered, 1 / np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return guess(text)


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score to every row (columns of these names are replaced).

    lang_pred is "und" with score 0 if the text is null or has no letter. Ties go to the
    first language in order of name. Only text_col is looked at.
    """
    bound_arrow_batches(docs.sparkSession)
    (guess,) = unused(docs.columns, "guess")
    guessed = docs.withColumn(guess, predict(F.col(text_col), model, docs.sparkSession))
    return guessed.select(*own_columns(docs, "lang_pred", "score"), f"{guess}.lang_pred", f"{guess}.score")
