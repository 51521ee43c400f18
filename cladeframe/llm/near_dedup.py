"""Near-duplicate documents by min-max hashing over word shingles (operator 3)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm._common import Scratch, hash_words, in_slices, mix
from cladeframe.llm.components import connected_components

ROWS, BANDS = 7, 42
#: Bits of the maps that bound overlaps.
BITS = 2048
_K = ROWS * BANDS // 2
_rng = np.random.default_rng(0x314159)
_A = _rng.integers(0, 2**63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, _K, dtype=np.uint64)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 2048


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; of fewer words, the whole sequence is the one shingle."""
    h = hash_words(text)
    if not len(h):
        return h
    n = min(words, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = mix(acc * _FOLD + h[k : len(h) - n + 1 + k])
    return np.unique(acc)


def minmax_bands(items: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band: each permutation is hashed once and gives both its minimum and its maximum."""
    low = np.full(_K, 2**64 - 1, np.uint64)
    high = np.zeros(_K, np.uint64)
    for at in range(0, len(items), _CHUNK):
        m = _A[:, None] * items[None, at : at + _CHUNK] + _B[:, None]
        np.minimum(low, m.min(axis=1), out=low)
        np.maximum(high, m.max(axis=1), out=high)
    rows = np.concatenate([low, high]).reshape(BANDS, ROWS)  # all minima or all maxima, so that a band's permutations differ
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = mix(acc * _FOLD + rows[:, k])
    return acc


def bitmap(items: np.ndarray) -> np.ndarray:
    """BITS bits as longs; an item sets the bit that its hash names."""
    flags = np.zeros(BITS, bool)
    flags[(items % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64)


def _key(items: np.ndarray) -> tuple[int, int]:
    index = np.arange(1, len(items) + 1, dtype=np.uint64)
    one = mix(items + index * _FOLD).sum(dtype=np.uint64)
    two = (mix(items ^ (index * np.uint64(0xA0761D6478BD642F))) * _FOLD).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, k1, k2, bands = [], [], [], []
            for text in texts:
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                a, b = _key(s) if len(s) else (None, None)
                k1.append(a)
                k2.append(b)
                bands.append(minmax_bands(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            columns = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["id", "items", "bits"])

    return run


def near_duplicates(documents: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """Components of the graph that links documents of Jaccard similarity >= similarity % over word shingles.

    Needs doc_id and text, other columns are ignored. One row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable), kept (doc_id = component_id).

    1. One pass sketches every whole text: 147 permutations give 147 minima and 147 maxima, folded into 21 bands of
       7 each. A band never holds minimum and maximum of one permutation, so sets of a few shingles fare as large
       ones do: a pair of similarity 0.8 shares no band with probability 5e-5.
    2. Documents of equal sets collapse to one representative before anything is paired.
    3. Each bucket compares its members with its smallest one only; verified links give first components.
    4. In buckets that still hold several components, the members of different components are compared with each
       other. Pairs within a component can't change the result, so no link that matters is lost, and a bucket of
       a thousand near copies costs a thousand comparisons. Bitmaps of the sets bound each overlap from above, so
       only pairs that may reach the similarity are made, and no link is lost by it.
    Every link is confirmed on the full sets of 64-bit shingle hashes. Null or blank texts have an empty set and
    are linked with nothing; rows that share a doc_id are one document; a null doc_id is never a component_id.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.write(docs.mapInArrow(in_slices(_sketches(words)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "sketch")
    reps = scratch.write(sketch.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    chosen = sketch.join(reps.select(F.col("rep").alias("doc_id"), F.col("k1").alias("r1"), F.col("k2").alias("r2")), "doc_id").where("k1 = r1 and k2 = r2")
    members = scratch.write(chosen.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "members")
    pivots = scratch.write(members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("p.id").alias("pid"), F.col("p.n").alias("pn")), "pivots")
    shared = scratch.write(members.join(pivots, "bucket"), "shared")
    scratch.drop("members", "pivots")

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * similarity
    needed = scratch.write(shared.select("id").distinct(), "needed")
    sets = scratch.write(docs.join(needed.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(in_slices(_sets(words)), "id long, items array<long>, bits array<long>"), "sets")

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        todo = scratch.write(pairs.distinct(), f"{tag}-pairs")
        left = scratch.write(todo.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a"), f"{tag}-left")
        both = F.size(F.array_intersect("x", "y"))
        linked = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").where(both * 100 >= (F.size("x") + F.size("y") - both) * similarity)
        out = scratch.write(linked.select("a", "b"), f"{tag}-links")
        scratch.drop(f"{tag}-pairs", f"{tag}-left")
        return out

    star = verified(shared.where((F.col("id") != F.col("pid")) & fits(F.col("n"), F.col("pn"))).select(F.col("pid").alias("a"), F.col("id").alias("b")), "star")
    first = connected_components(spark, star, scratch, "first")
    placed = shared.join(first.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label"))
    placed = scratch.write(placed, "placed")
    mixed = scratch.write(placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    open_ = scratch.write(placed.join(mixed, "bucket", "left_semi"), "open")
    scratch.drop("shared", "placed", "mixed")
    # Each bit that one set has and the other has not is an item they don't share: an exact bound of the overlap,
    # tested while the bucket's members meet, so a pair that can't be similar is never made.
    open_ = scratch.write(open_.join(sets.select("id", "bits"), "id"), "marked")
    scratch.drop("open")
    other = open_.select("bucket", *(F.col(c).alias(f"o_{c}") for c in ("id", "n", "label", "bits")))
    lone = lambda x, y: reduce(lambda a, b: a + b, (F.bit_count(F.get(x, k).bitwiseAND(F.bitwise_not(F.get(y, k)))) for k in map(F.lit, range(BITS // 64))))
    most = F.least(F.col("n") - lone("bits", "o_bits"), F.col("o_n") - lone("o_bits", "bits"))
    possible = fits(F.col("n"), F.col("o_n")) & (most * 100 >= (F.col("n") + F.col("o_n") - most) * similarity)
    cross = open_.join(other, "bucket").where((F.col("id") < F.col("o_id")) & (F.col("label") != F.col("o_label")) & possible)
    second = verified(cross.select(F.col("id").alias("a"), F.col("o_id").alias("b")), "cross")
    parts = connected_components(spark, star.union(second), scratch, "all")
    scratch.drop("marked", "sets", "needed", "star-links", "cross-links", "first-components")

    rep_part = scratch.write(reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component_id")), "parts")
    scratch.drop("reps", "all-components")
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(rep_part, ["k1", "k2"], "left")
    part = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.col("doc_id").eqNullSafe(part).alias("kept"))
