"""Line dedup by a join of deletion neighbourhoods.

The edit bound is one: two lines are near if one unit changed, left or joined turns one into
the other. The unit of a line of MIN_EDIT_WORDS words and more is the word: a deleted word's
key covers every change of characters within it, so no character's variant is lost, and a
line has a sixth as many keys. In lines of fewer than SURE_WORDS words, a word that holds more
than half of the line's characters must agree but for one character. The unit of lines of
fewer words, from MIN_EDIT_CHARS characters on, is the character. Lines are also near if one
space dropped or added turns one into the other; the shorter one may have a word less.

1. Equal lines are grouped by fingerprint; each distinct line knows its first place.
2. If one unit differs, the first or the last half of the units is equal. Distinct lines that
   share no half with another of nearly their length, nor their letters without the spaces
   with any, can have no near line and go no further.
   This loses nothing and keeps the variants to a small share of the lines.
3. The others emit the hash of the line without unit k for every slot k, and their own hash
   for every slot where a unit could be put in. Lines that share (hash, slot) are near each
   other, all of them: they differ in that slot alone. A word that must nearly agree has the
   slots of its characters instead.
4. The earliest line of each such group is joined with the others, and the edit distance is
   verified.
5. Of lines that are equal without spaces, each with one space dropped is joined with the one
   that is so by itself; the later of the two goes.

A template line with one free word is a hot key: groups are combined before they are shuffled,
and the joins of their members with them are inner joins that adaptive execution splits.

A line goes if an equal or near line stands earlier, by doc_id and then by place in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.near_dups import mixed, normal_words, word_hashes
from cloudframe.llm.shared import bound_arrow_batches, discard, fingerprint, materialize, own_columns, unused

#: Blank lines are never dropped; from MIN_EDIT_WORDS on a line goes for one a word apart too, from SURE_WORDS on whatever
#: the word's length; shorter lines of MIN_EDIT_CHARS go for one a character apart.
MIN_WORDS, MIN_EDIT_WORDS, SURE_WORDS, MIN_EDIT_CHARS = 1, 4, 10, 12
#: Up to so many rows of (doc_id, hash, line numbers) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_LINES = 200_000, 1_000_000
#: A number odd by construction and its inverse modulo 2^64, for each of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def slot_hashes(words: list[str]) -> np.ndarray:
    """(2n + 1) x 2 hashes: of the line without unit k, k < n; then of the whole line with slot k, k <= n."""
    h, n = mixed(word_hashes(words)), len(words)
    columns = []
    for base, inverse in zip(BASES, INVERSES, strict=True):
        powers = np.cumprod(np.full(n, np.uint64(base)))
        before = np.concatenate([[np.uint64(0)], np.cumsum(h * powers)])
        without = before[:-1] + (before[-1] - before[1:]) * np.uint64(inverse)
        values = np.concatenate([without, np.full(n + 1, before[-1])])
        slots = np.concatenate([np.arange(n, dtype=np.uint64), np.arange(n + 1, dtype=np.uint64)])
        columns.append(mixed(mixed(values) + slots * np.uint64(base)))
    return np.stack(columns, axis=1).view(np.int64)


def within_one_word(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two lists of words, or of characters, is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = next((k for k, word in enumerate(short) if word != long[k]), len(short))
    return short[at:] == long[at + 1 :] or short[at + 1 :] == long[at + 1 :]


def is_long(words: list[str], k: int, more: int = 0) -> bool:
    """Whether word k, with `more` characters more, holds over half the characters of a line of few words."""
    return len(words) < SURE_WORDS and 2 * (len(words[k]) + more) > sum(map(len, words)) + len(words) - 1 + more


def one_space_apart(a: list[str], b: list[str]) -> bool:
    """Whether joining two neighbours in one of the lists gives the other."""
    short, long = sorted((a, b), key=len)
    if len(long) != len(short) + 1:
        return False
    at = next((k for k, word in enumerate(short) if word != long[k]), len(short))
    return at < len(short) and short[at] == long[at] + long[at + 1] and short[at + 1 :] == long[at + 2 :]


def by_characters(words: list[str]) -> list[str] | None:
    """The characters of a line of few words that is long enough to be compared by them."""
    line = " ".join(words)
    return list(line) if len(words) < MIN_EDIT_WORDS and len(line) >= MIN_EDIT_CHARS else None


def near_lines(a: list[str], b: list[str]) -> bool:
    """Whether of two lists of words, one goes for the other."""
    x, y = by_characters(a), by_characters(b)
    if x and y and within_one_word(x, y):
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= MIN_EDIT_WORDS and within_one_word(a, b):
        at = next((k for k, word in enumerate(short) if word != long[k]), len(short))
        if at == len(long) or len(long) > len(short) and not is_long(long, at):
            return True
        if len(long) == len(short) and (not (is_long(a, at) or is_long(b, at)) or within_one_word(list(a[at]), list(b[at]))):
            return True
    return len(short) >= MIN_EDIT_WORDS - 1 and one_space_apart(a, b)


def edit_verified(a: Column, b: Column) -> Column:
    @F.arrow_udf("boolean")
    def verify(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([near_lines(line_words(x), line_words(y)) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.bool_())

    return verify(a, b)


def variant_hashes(words: list[str]) -> np.ndarray:
    """slot_hashes() of a line's units; a word that must nearly agree has the slots of its characters."""
    if len(words) < MIN_EDIT_WORDS:
        characters = by_characters(words)
        return slot_hashes(characters) if characters else np.zeros((0, 2), np.int64)
    keys = slot_hashes(words)
    if len(words) >= SURE_WORDS:
        return keys
    parts = [np.delete(keys, [k for k in range(len(words)) if is_long(words, k)], axis=0)]
    for k in range(len(words)):
        if is_long(words, k, 1):
            parts.append(mixed(mixed(slot_hashes(list(words[k])).view(np.uint64)) + keys[k].view(np.uint64)).view(np.int64))
    return np.concatenate(parts)


def space_hashes(words: list[str]) -> np.ndarray:
    """n x 2 hashes of a line's letters and places of spaces: all of them, then all but space k."""
    letters, ends = "".join(words), np.cumsum([len(w) for w in words[:-1]]).astype(np.uint64)
    columns = []
    for seed, base in enumerate(BASES):
        places = mixed((ends + np.uint64(1)) * np.uint64(base))
        total = places.sum(dtype=np.uint64) + np.full(1, xxhash.xxh3_64_intdigest(letters, seed), np.uint64)
        columns.append(np.concatenate([total, total - places]))
    return np.stack(columns, axis=1).view(np.int64)


def _spacings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From line, words: line, s1, s2, own; own is true for the hash with all spaces."""
    for batch in batches:
        for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys = space_hashes(line_words(text))
            columns = [np.full(len(keys), line), keys[:, 0].copy(), keys[:, 1].copy(), np.arange(len(keys)) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["line", "s1", "s2", "own"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, found, size = [], [], 0
        for line, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.append(variant_hashes(line_words(words)))
            lines.append(np.full(len(found[-1]), line))
            size += len(lines[-1])
            if size >= 65_536:
                yield _variant_batch(lines, found)
                lines, found, size = [], [], 0
        if lines:
            yield _variant_batch(lines, found)


def _variant_batch(lines: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
    keys = np.concatenate(found)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(lines)), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))], ["line", "v1", "v2"])


def line_words(line: str) -> list[str]:
    """What a line is compared by: its words in lower case."""
    return line.lower().split()


def line_hashes(words: list[str]) -> tuple:
    """Two hashes of the words, one of their letters, and four of the first and last half of the units; None where a line has none.

    The halves are those of the lesser of two lengths that differ by at most one: once with
    this line's length as the lesser, once with one unit less (if that is enough units).
    """
    whole, units, enough, joint = " ".join(words), words, MIN_EDIT_WORDS, " "
    letters = xxhash.xxh3_64_intdigest("".join(words), 2) if len(words) >= MIN_EDIT_WORDS - 1 else None
    if len(words) < MIN_EDIT_WORDS:
        units, enough, joint = by_characters(words), MIN_EDIT_CHARS, ""
    keys = (xxhash.xxh3_64_intdigest(whole), xxhash.xxh3_64_intdigest(whole, 1), letters)
    if units is None:
        return *keys, None, None, None, None
    n, kind = len(units), len(joint)
    halves = (xxhash.xxh3_64_intdigest(joint.join(part), 4 * least + 2 * last + kind) for least in (n, max(n - 1, enough)) for last, part in enumerate((units[: least // 2], units[n - least // 2 :])))
    return *keys, *halves


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc_id, f1, f2, text: a row for each line of at least MIN_WORDS words."""
    for batch in batches:
        rows, places, hashes = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for place, line in enumerate(text.split("\n")):
                words = line_words(line)
                if len(words) >= MIN_WORDS:
                    rows.append(row)
                    places.append(place)
                    hashes.append(line_hashes(words))
            if len(rows) >= 65_536 or row + 1 == batch.num_rows and rows:
                columns = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "f1", "f2")] + [pa.array(places, pa.int32())]
                columns += [pa.array(k, pa.uint64()).view(pa.int64()) for k in zip(*hashes, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "f1", "f2", "line_no", "l1", "l2", "glued", "half0", "half1", "half2", "half3"])
                rows, places, hashes = [], [], []


def _bounded(df: DataFrame, lines: Column | None = None) -> DataFrame:
    """Broadcast df if its counted rows, and line numbers in all, are within the bounds."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(lines), F.lit(0)) if lines is not None else F.lit(0)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_LINES else df


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2, gone: array of line numbers) of the lines to drop, a table of the shared folder.

    docs has doc_id, text, f1, f2 (fingerprint of text).
    """
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "f1", "f2", "line_no")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", "f1", "f2", "text").mapInArrow(_hashed_lines, f"doc_id {id_type}, f1 bigint, f2 bigint, line_no int, l1 bigint, l2 bigint, glued bigint, half0 bigint, half1 bigint, half2 bigint, half3 bigint")
    keys = ["glued", *(f"half{k}" for k in range(4))]
    lines = materialize(hashed)
    keyed = lines.select("l1", "l2", place.alias("place"), *keys)
    distinct = keyed.groupBy("l1", "l2").agg(F.min("place").alias("first"), F.count("*").alias("n"), *(F.min(k).alias(k) for k in keys))
    distinct = materialize(distinct.withColumn("line", F.monotonically_increasing_id()))

    halves = distinct.select("line", F.explode(F.array_compact(F.array(*keys))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a < b").select("half")
    lonely = distinct.join(halves.join(shared, "half").select("line").distinct(), "line").select("line", "first")
    wanted = materialize(lonely.groupBy("first.doc_id", "first.f1", "first.f2").agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "line")).alias("wanted")))
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.f1") == F.col("w.f1")) & (F.col("d.f2") == F.col("w.f2"))
    found = docs.alias("d").join(_bounded(wanted, F.size("wanted")).alias("w"), same).select(F.explode("wanted").alias("w"), F.split("text", "\n").alias("raw"))
    texts = materialize(found.select("w.line", F.col("raw")[F.col("w.line_no")].alias("words")).dropDuplicates(["line"]))

    variants = texts.mapInArrow(_variants, "line bigint, v1 bigint, v2 bigint")
    groups = variants.groupBy("v1", "v2").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a < b").select("v1", "v2")
    members = materialize(variants.join(groups, ["v1", "v2"]).join(distinct.select("line", "first"), "line"))
    earliest = members.groupBy("v1", "v2").agg(F.min(F.struct("first", F.col("line").alias("head"))).alias("e")).select("v1", "v2", "e.head")
    pairs = members.join(earliest, ["v1", "v2"]).where("line <> head").select("line", "head").distinct()
    glued = distinct.where("glued is not null").groupBy("glued").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a < b").select("glued")
    alike = materialize(distinct.join(glued, "glued").select("line", "first").join(texts, "line"))
    spacings = alike.select("line", "words").mapInArrow(_spacings, "line bigint, s1 bigint, s2 bigint, own boolean").join(alike.select("line", "first"), "line")
    own = spacings.where("own").select("s1", "s2", F.struct("first", "line").alias("x"))
    spaced = own.join(spacings.where("not own").select("s1", "s2", F.struct("first", "line").alias("y")), ["s1", "s2"])
    pairs = pairs.unionByName(spaced.select(F.greatest("x", "y").getField("line").alias("line"), F.least("x", "y").getField("line").alias("head")).distinct())
    heads = texts.select(F.col("line").alias("head"), F.col("words").alias("head_words"))
    near = pairs.join(texts, "line").join(heads, "head").where(edit_verified(F.col("words"), F.col("head_words"))).select("line").distinct()

    marked = materialize(distinct.join(near.withColumn("near", F.lit(True)), "line", "left").where("n > 1 or near").select("l1", "l2", "first", "near"))
    discard(distinct, wanted, texts, members, alike)
    gone = keyed.select("l1", "l2", "place").join(marked, ["l1", "l2"]).where("near or place <> first")
    found = materialize(gone.groupBy("place.doc_id", "place.f1", "place.f2").agg(F.collect_set("place.line_no").alias("gone")))
    discard(lines, marked)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that an equal or near line precedes; every row of docs stays.

    The text has the remaining lines between newlines; null stays null. Added columns:
    n_lines, n_dropped (long; columns of these names are replaced). Blank lines always
    stay. Rows of null doc_id come last in the order. Rows equal in
    doc_id and text count as one document and come out alike.
    """
    done, counts = _deduped(docs, id_col, text_col)
    return done.select(*own_columns(docs, *COUNTS), *(F.col(c).alias(n) for c, n in zip(counts, COUNTS, strict=True)))


COUNTS = ("n_lines", "n_dropped")


def _deduped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with the lines that stay and two more columns, and their names, that none of its own has."""
    bound_arrow_batches(docs.sparkSession)
    f1, f2 = fingerprint(F.col(text_col))
    keys = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), f1.alias("f1"), f2.alias("f2"))
    n_lines, n_dropped, i, g1, g2, gone, lines = unused(docs.columns, *COUNTS, "gone_id", "f1", "f2", "gone", "lines")
    table = dropped_lines(keys).select(F.col("doc_id").alias(i), F.col("f1").alias(g1), F.col("f2").alias(g2), F.col("gone").alias(gone))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (f1 == F.col(g1)) & (f2 == F.col(g2))
    met = docs.join(_bounded(table, F.size(gone)), same, "left").withColumn(lines, F.split(text_col, "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda k: F.col(lines)[k])
    counted = met.withColumns({n: F.greatest(F.size(c), F.lit(0)).cast("bigint") for n, c in ((n_lines, lines), (n_dropped, gone))})
    return counted.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))), [n_lines, n_dropped]


def keep_new_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay, its own columns only; documents of which no word is left go."""
    done, (_, n_dropped) = _deduped(docs, id_col, text_col)
    return done.where((F.col(n_dropped) == 0) | (normal_words(F.col(text_col)) != "")).select(*own_columns(docs))
