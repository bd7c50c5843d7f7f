"""Near-duplicate documents by ProbMinHash, banding and verification.

Candidates are found by the probability Jaccard of weighted five-word shingles. A shingle's weight
is its length in letters: it depends on the shingle alone, so two texts agree on the weight of
what they share, and a text isn't parted from its copy that repeats a passage, as weights by
count would part it. Pairs are verified by the Jaccard similarity of the shingles' sets; the
weighted one differs from it by as much as shared shingles are longer or shorter than others.

1. One pass over the texts gives each row a fingerprint of its words and the band hashes of
   its ProbMinHash signature. Rows of equal fingerprint are exact copies: they share a node.
2. Nodes that agree in a band share a bucket. Each bucket's first and last node are compared
   with all others in it (a pair for each member, not each pair of members).
3. What these leave in different components of a bucket meets block by block: a task gets the
   shingles of two blocks, of bounded bytes, works out all their similarities, and returns
   links that span its components, fewer than it has nodes. So every two nodes that share a
   bucket are compared, or known to be connected, and no link between components is lost.

Two nodes are linked if their similarity is at least the threshold. Classes are the connected
components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.components import connected_components
from cloudframe.llm.shared import bound_arrow_batches, discard, fingerprint, materialize, own_columns, unused

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sketch:
    """bands x rows components. At similarity 0.8 a pair meets in a band with probability 0.997, at 0.85 with 0.99999."""

    shingle_words: int = 5
    bands: int = 40
    rows: int = 9
    threshold: float = 0.8
    #: Nodes, and bytes of their shingles, that a block of a bucket holds.
    block: int = 256
    block_bytes: int = 16 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, n_words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text of words between single spaces.

    A text of fewer words is one shingle; an empty text has none.
    """
    return np.unique(_each_shingle(text.split(" ") if text else [], n_words))


def weighted_shingles(text: str, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), and each one's weight: the letters of its words, at least 1."""
    words = text.split(" ") if text else []
    hashes, first = np.unique(_each_shingle(words, n_words), return_index=True)
    upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return hashes, np.maximum(1.0, upto[np.minimum(first + n_words, len(words))] - upto[first])


def _each_shingle(words: list[str], n_words: int) -> np.ndarray:
    h = word_hashes(words)
    size = max(1, len(h) - n_words + 1) if len(h) else 0
    total = np.full(size, np.uint64(len(words) if len(words) < n_words else n_words))
    for k in range(min(n_words, len(h))):
        total = mixed(total + GOLDEN) + h[k : k + size]
    return mixed(total)


def prob_min_hash(hashes: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (documents x m) of weighted sets.

    Each element is a Poisson process of its weight as rate; its arrivals go to random
    components, and each component keeps the element that arrives first. An element ends
    when its time exceeds the latest of its document's components. Two documents agree in a
    component with the probability Jaccard similarity of their weighted sets. Arrivals of
    all elements still active are drawn in blocks that grow, as few elements remain.
    """
    n = len(hashes)
    doc = np.repeat(np.arange(n), [len(h) for h in hashes])
    element = np.concatenate(hashes) if n else np.zeros(0, np.uint64)
    rate = np.concatenate(weights).astype(np.float64) if n else np.zeros(0)
    first, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, drawn, block = np.zeros(len(element)), 0, 1
    latest = np.full(n, np.inf)
    while len(element):
        step = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64) * GOLDEN
        bits = mixed(element[:, None] + step)
        gap = -np.log((((bits >> np.uint64(11)).astype(np.float64)) + 0.5) * 2.0**-53)
        at = time[:, None] + np.cumsum(gap / rate[:, None], axis=1)
        row, col = np.nonzero(at < latest[doc][:, None])
        when = at[row, col]
        slot = doc[row] * m + (mixed(bits[row, col] ^ GOLDEN) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, when)
        won = first[slot] == when
        winner[slot[won]] = element[row[won]]
        latest = first.reshape(n, m).max(axis=1)
        time = at[:, -1]
        active = time < latest[doc]
        doc, element, rate, time = doc[active], element[active], rate[active], time[active]
        drawn += block
        block = min(256, max(block, drawn))
    return winner.reshape(n, m)


def band_hashes(signatures: np.ndarray, sketch: Sketch) -> np.ndarray:
    """documents x bands: one 64-bit hash of each band's number and components."""
    grouped = signatures.reshape(len(signatures), sketch.bands, sketch.rows)
    out = np.tile(np.arange(1, sketch.bands + 1, dtype=np.uint64), (len(signatures), 1))
    for k in range(sketch.rows):
        out = mixed(out + GOLDEN) + grouped[:, :, k]
    return mixed(out).view(np.int64)


def normal_words(text: Column) -> Column:
    """Lower-case words between single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def bands_of(words: Column, sketch: Sketch) -> Column:
    """array<bigint> with the band hashes of each text's signature; empty for a text without words."""

    @F.arrow_udf("array<bigint>")
    def bands(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            texts = texts.to_pylist()
            for at in range(0, len(texts), 256):
                sets = [weighted_shingles(t, sketch.shingle_words) for t in texts[at : at + 256]]
                full = [(h, w) for h, w in sets if len(h)]
                signed = band_hashes(prob_min_hash([h for h, _ in full], [w for _, w in full], sketch.bands * sketch.rows), sketch)
                found = iter(signed)
                parts.extend(next(found) if len(h) else [] for h, _ in sets)
            yield pa.array(parts, pa.list_(pa.int64()))

    return bands(words)


def shingles_of(words: Column, sketch: Sketch) -> Column:
    """array<bigint> with the sorted distinct shingle hashes of each text."""

    @F.arrow_udf("array<bigint>")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingles(t, sketch.shingle_words).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return hashes(words)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct numbers."""

    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = left.flatten().to_numpy(), right.flatten().to_numpy()
        i, j = (np.concatenate([[0], np.cumsum(z.value_lengths().to_numpy())]) for z in (left, right))
        out = np.zeros(len(left))
        for k in range(len(left)):
            both = np.concatenate([x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out[k] = common / max(1, len(both) - common)
        return pa.array(out)

    return similarity(a, b)


def spanning_links(node: np.ndarray, component: np.ndarray, first: np.ndarray, second: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect what the links of nodes in `first` with nodes in `second` connect, given the components so far.

    first and second are masks. The sets' common elements are counted for all pairs at once,
    as products of bounded slices of the incidence matrix.
    """
    size = np.array([len(x) for x in sets])
    elements, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    met = np.bincount(column, minlength=len(elements)) > 1  # others are in no intersection
    column = (np.cumsum(met) - 1)[column[(shared := met[column])]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    for low in range(0, int(met.sum()), width):
        i, j = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        common += part @ part.T
    linked = common >= threshold * (size[:, None] + size - common)
    linked &= (first[:, None] & second) | (second[:, None] & first)
    label, out = component.copy(), []
    for k in range(len(sets)):
        near = np.flatnonzero(linked[k] & (label != label[k]))
        while len(near):
            out.append((int(min(node[k], node[near[0]])), int(max(node[k], node[near[0]]))))
            label[label == label[near[0]]] = label[k]
            near = near[label[near] != label[k]]
    return out


def block_links(rest: DataFrame, sets: DataFrame, sketch: Sketch) -> DataFrame:
    """Links (src, dst) between components among nodes of a bucket; rest has bucket, node and component, sets node, grams and size.

    A bucket of more than one block is dealt out to pairs of blocks, so no task gets it whole.
    """

    def compare(table: pa.Table) -> pa.Table:
        node, component, own, first, last = (table[c].to_numpy() for c in ("node", "component", "own", "low_block", "high_block"))
        sets = [x.values.to_numpy() for x in table["grams"]]
        links = spanning_links(node, component, own == first, own == last, sets, sketch.threshold)
        columns = list(zip(*links, strict=True)) or [[], []]
        return pa.table({"src": pa.array(columns[0], pa.int64()), "dst": pa.array(columns[1], pa.int64())})

    sized = rest.join(sets.select("node", "size"), "node")
    need = F.greatest(F.count("*") / sketch.block, F.sum("size") * 8 / sketch.block_bytes)
    blocks = sized.groupBy("bucket").agg(F.ceil(need).cast("int").alias("blocks"))
    dealt = rest.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.withColumns({"low_block": F.least("own", "met"), "high_block": F.greatest("own", "met")}).join(sets.select("node", "grams"), "node")
    keyed = keyed.select("bucket", "low_block", "high_block", "own", "node", "component", "grams")
    return keyed.groupBy("bucket", "low_block", "high_block").applyInArrow(compare, "src bigint, dst bigint").distinct()


def fitting(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (src, dst), those whose sets' sizes allow for the threshold."""
    for side, name in (("src", "nx"), ("dst", "ny")):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("size").alias(name)), side)
    return pairs.where(F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")).select("src", "dst")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (src, dst), those whose sets' similarity is at least the threshold."""
    x = sets.select(F.col("node").alias("src"), F.col("grams").alias("x"))
    y = sets.select(F.col("node").alias("dst"), F.col("grams").alias("y"))
    met = pairs.join(x, "src").join(y, "dst")
    return met.withColumn("similarity", jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= threshold).select("src", "dst")


def near_duplicate_classes(docs: DataFrame, sketch: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, h1, h2, class_id, class_rows, is_kept.

    class_id is the least doc_id in the class (null only if all are null); class_rows its
    number of rows; is_kept is true for exactly one of them, the one of least doc_id, ties
    to any one of them. Rows of equal words are copies. h1 and h2 are the fingerprint of the
    words. A text without words (null, empty, white space) is a class of its own.
    """
    bound_arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), normal_words(F.col(text_col)).alias("words")).select("doc_id", "words", *(h.alias(n) for h, n in zip(fingerprint(F.col("words")), ("h1", "h2"), strict=True)))
    rows = materialize(texts.select("doc_id", "h1", "h2", bands_of(F.col("words"), sketch).alias("bands")).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    nodes = materialize(rows.where(F.size("bands") > 0).groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))

    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = materialize(members.join(buckets, "bucket"))
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "h1", "h2", F.col("first.doc_id").alias("doc_id"))
    same = (F.col("t.h1") == F.col("w.h1")) & (F.col("t.h2") == F.col("w.h2")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    sets = materialize(texts.alias("t").join(wanted.alias("w"), same).select("w.node", "t.words").dropDuplicates(["node"]).select("node", shingles_of(F.col("words"), sketch).alias("grams")).withColumn("size", F.size("grams")))

    def known(pairs: DataFrame, components: DataFrame) -> DataFrame:
        """Pairs of nodes that aren't connected yet."""
        for side in ("src", "dst"):
            label = components.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
            pairs = pairs.join(label, side, "left").withColumn(f"{side}_component", F.coalesce(f"{side}_component", side))
        return pairs.where("src_component <> dst_component").select("src", "dst")

    tried = members.select(F.col("low").alias("src"), F.col("node").alias("dst")).where("src <> dst").distinct()
    to_low = materialize(verified(fitting(tried, sets, sketch.threshold), sets, sketch.threshold))
    by_low = connected_components(to_low)
    pairs = members.select(F.col("node").alias("src"), F.col("high").alias("dst")).where("src <> dst").distinct()
    to_ends = materialize(to_low.unionByName(verified(fitting(known(pairs, by_low), sets, sketch.threshold), sets, sketch.threshold)))
    by_ends = connected_components(to_ends)
    discard(to_low, by_low)
    inner = members.where("node <> low and node <> high").join(by_ends, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = inner.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("bucket")
    rest = materialize(inner.join(split, "bucket"))
    links = materialize(to_ends.unionByName(block_links(rest, sets, sketch)))
    components = connected_components(links)
    discard(members, sets, to_ends, by_ends, rest, links)

    labelled = nodes.join(components, "node", "left").select("h1", "h2", "first", "copies", F.coalesce("component", "node").alias("component"))
    classes = labelled.groupBy("component").agg(F.min("first").alias("kept"), F.sum("copies").alias("class_rows"))
    named = labelled.join(classes, "component").select("h1", "h2", "kept", "class_rows")
    found = rows.join(named, ["h1", "h2"], "left")
    alone = F.col("kept").isNull()
    return found.select(
        "doc_id", "h1", "h2",
        F.when(alone, F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).cast("bigint").alias("class_rows"),
        (alone | (F.col("kept.row") == F.col("row"))).alias("is_kept"),
    )


def keep_one_of_each(docs: DataFrame, sketch: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class, its own columns only.

    Rows without words stay as they are. Rows that share doc_id and words count as one.
    """
    classes = materialize(near_duplicate_classes(docs, sketch, id_col, text_col))
    x1, x2, i, k1, k2 = unused(docs.columns, "x1", "x2", "kept_id", "h1", "h2")
    kept = classes.where("is_kept").select(F.col("doc_id").alias(i), F.col("h1").alias(k1), F.col("h2").alias(k2)).distinct()
    words = normal_words(F.col(text_col))
    h1, h2 = fingerprint(words)
    same = (F.col(x1) == F.col(k1)) & (F.col(x2) == F.col(k2)) & F.col(id_col).eqNullSafe(F.col(i))
    one = docs.where(words != "").withColumns({x1: h1, x2: h2}).join(kept, same, "left_semi")
    if not classes.where("class_rows > 1").groupBy("doc_id", "h1", "h2").count().where("count > 1").isEmpty():
        one = one.dropDuplicates([id_col, x1, x2])
    return one.select(*own_columns(docs)).unionByName(docs.where(words == ""))
