"""Fill-in-middle: cut documents at word boundaries into prefix, middle and suffix, and reorder them.

A token is white space and the characters up to the next white space, or white space at a
text's end. One numpy kernel works on the UTF-8 bytes of a whole Arrow batch: bytes are looked
up in a table of classes, a token starts where white space follows another byte or a text
begins, and sums that begin anew with each document number the tokens. The cuts of all rows are
then looked up together in the sums. White space is ASCII, so that no cut falls within a
character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.shared import bound_arrow_batches, own_columns, unused

#: Bytes of text that the kernel works on at once.
RUN_BYTES = 2 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Whether a byte is white space.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
RESULT = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,output:string>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on seed and id alone; a null id counts as an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts between the offsets of `data`: how many tokens start up to each byte, within its text; tokens of each text.

    The first array has one entry more than data, and counts over all texts; the base of a text
    is its entry at the text's offset.
    """
    space = SPACE[data]
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[filled] = True
    upto = np.zeros(len(data) + 1, np.int32)
    np.cumsum(starts, out=upto[1:])
    return upto, (upto[offsets[1:]] - upto[offsets[:-1]]).astype(np.int64)


def runs(texts: pa.Array) -> list[tuple[int, int]]:
    """(first row, rows) of runs of texts of some RUN_BYTES together, or of one longer text: the kernel takes about ten bytes for each of theirs."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // RUN_BYTES)) + 1
    starts = np.concatenate([[0], cuts])
    return list(zip(starts.tolist(), np.diff(np.append(starts, len(sizes))).tolist(), strict=True))


def cut_batch(texts: pa.Array, first: pa.Array, second: pa.Array, forms: pa.Array) -> pa.StructArray:
    """The result column of some rows: texts without nulls, two draws of each row, and its form."""
    first, second = first.to_numpy(), second.to_numpy()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    base, end = int(offsets[0]), int(offsets[-1])
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[base:end] if body is not None else np.zeros(0, np.uint8)
    offsets -= base
    upto, n = token_starts(data, offsets)
    low, high = np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))

    def place(k: np.ndarray) -> np.ndarray:
        """Where the token number k of each row starts; the text's end if it has no more."""
        at = np.searchsorted(upto[1:], (upto[offsets[:-1]] + k + 1).astype(np.int32))
        return np.where(k < n, at, offsets[1:])

    a, b = place(low), place(high)
    # One array of 3 x rows strings over the same bytes: prefix, middle and suffix of each row in turn.
    cuts = np.append(np.stack([offsets[:-1], a, b], axis=1).ravel(), offsets[-1]).astype(np.int32)
    parts = pa.StringArray.from_buffers(3 * len(texts), pa.py_buffer(cuts), pa.py_buffer(data))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * len(texts), 3))) for k in range(3))
    plain, spm = pc.equal(forms, "plain"), pc.equal(forms, "spm")
    join = lambda *p: pc.binary_join_element_wise(*p, "")
    output = pc.if_else(plain, texts, pc.if_else(spm, join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    counted = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return pa.StructArray.from_arrays([pa.array(n), *counted, output], ["n", "prefix_chars", "middle_chars", "output"])


def _cut(*columns: Column) -> Column:
    @F.arrow_udf(RESULT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, *rest in batches:
            parts = [cut_batch(*(c.slice(at, n) for c in (texts, *rest))) for at, n in runs(texts)]
            yield pa.concat_arrays(parts) if len(parts) != 1 else parts[0]

    return cut(*columns)


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_share: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the column `fim`: a struct of form, n, prefix_chars, middle_chars and output.

    `rate` percent of the texts are reordered, `spm_share` percent of those suffix first (form
    spm), the others prefix first (psm). An empty or null text, and one that holds a marker
    already, is plain: its output is the text, its two lengths (in code points) are null. Cuts
    and form depend on seed and id alone, so rows of equal id and text come out equal. Texts are
    never shuffled; other columns stay in the JVM, a column named fim is replaced.
    """
    bound_arrow_batches(docs.sparkSession)
    form, cut = unused(docs.columns, "form", "cut")
    text, (h1, h2, h3, h4) = F.coalesce(F.col(text_col), F.lit("")), draws(F.col(id_col), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    forms = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    rows = docs.withColumn(form, forms)
    rows = rows.withColumn(cut, _cut(text, h1, h2, F.col(form)))
    fim = F.struct(F.col(form).alias("form"), *(F.col(f"{cut}.{c}").alias(c) for c in ("n", "prefix_chars", "middle_chars", "output")))
    return rows.select(*own_columns(docs, "fim"), fim.alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts of other forms than plain hold no marker, so the first one found is the one set."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    outer, inner = (lambda sign: F.substring_index(rest, sign, -1)), (lambda sign: rest.substr(F.lit(4), F.instr(rest, sign) - 4))
    return F.when(form == "plain", output).when(form == "spm", F.concat(outer(PREFIX), middle, inner(PREFIX))).otherwise(F.concat(inner(SUFFIX), middle, outer(SUFFIX)))


#: As op13_fill_in_middle, for DuckDB.
ORACLE_SQL = r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (
    SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
           ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM hashed),
placed AS (
    SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut),
parts AS (
    SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle,
           coalesce(array_to_string(tokens[b + 1:n], ''), '') AS suffix
    FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
