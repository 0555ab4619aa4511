"""Near-duplicate detection by min-max hashing.

A document is its set of distinct word n-grams (64-bit hashes). Each of PERMUTATIONS hash permutations of a set keeps
its smallest and its largest value: two signature values for one pass of hashes. Either agrees between two sets with a
chance of their Jaccard similarity, so the share of agreeing values estimates it without bias, and as minimum and
maximum hardly depend on each other (they fall on different n-grams), with a lower variance than as many minima alone
would give for the same number of hashes. The values are cut into bands of ROWS / 2 permutations each (minima and
maxima); sets that agree on a whole band share a bucket. Of two sets of similarity s a band agrees with a chance of
about s**ROWS, so at 0.85 all bands miss a pair with a chance of about 6e-9, at 0.8 of 6e-6.

Bucket mates are candidates, and every link is confirmed on the whole sets. Large groups of near copies share their
buckets; they are compared through hubs and families, as grouped() of the n-gram join does for any postings, so that
not all pairs of a group are made. Equal sets are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import slices, staged, table
from emberwatch.llm.ngramjoin import grouped, set_hash, shingle_sets

BANDS = 40
ROWS = 6                            # signature values of a band: minima and maxima of ROWS / 2 permutations
PERMUTATIONS = BANDS * ROWS // 2
PIECE = 1 << 13                     # n-grams hashed at once, so a very long text takes bounded memory

_U = np.uint64


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240713).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draw[0] * _U(2) + _U(1), draw[1]


def signature(grams: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(2, permutations): the smallest and the largest value of a set of n-gram hashes under every permutation."""
    odd, shift = _factors(permutations)
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    for at in range(0, len(grams), PIECE):
        values = grams[at:at + PIECE, None] * odd + shift  # a permutation of 64-bit numbers
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return np.stack([low, high])


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Unbiased estimate of the Jaccard similarity of two sets from their signatures."""
    return float((a == b).mean())


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for every band, of the band's number and all its minima and maxima."""
    rows = np.concatenate(np.split(sig, bands, axis=1)).reshape(bands, -1)  # band j: its minima, then its maxima
    h = np.arange(bands, dtype=np.uint64) + _U(1)
    for column in rows.T:
        h = (h ^ column) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return h.view(np.int64)


def band_table(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, cls (hash of the set, null if empty) and the band keys of every document."""
    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            size, cls, keys = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                size.append(len(s))
                cls.append(set_hash(s) if len(s) else None)
                keys.append(band_keys(signature(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "cls", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_shingles long, cls long, keys array<long>")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Groups documents whose sets of distinct word n-grams have 100 * intersection >= percent * union.

    Returns doc_id, n_shingles (size of the set), component_id (the smallest doc_id reachable by links, itself included)
    and kept (doc_id = component_id). ASCII letters are lower-cased; words are runs of anything but blanks and control
    spaces of the whole text, however long; with fewer words than n the whole sequence is one n-gram. Documents without
    words, or null texts, have 0 n-grams, are linked with nothing and kept (if they have a doc_id). Null doc_ids are never
    the smallest: a group of nothing else has a null component_id and kept is false. Repeated rows are returned each (and kept
    each, if their id is the group's); other columns are ignored, whatever their names; an empty table gives no rows."""
    every = staged(band_table(docs, n), "bands")
    some = every.where(F.col("cls").isNotNull())
    reps = some.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    classes = staged(some.select("cls", F.col("n_shingles").alias("size"), F.lit(1).alias("level"), "keys").dropDuplicates(["cls"]).join(reps, "cls"), "classes")
    single = classes.select("cls", F.explode("keys").alias("token"))
    common = single.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("token")
    posts = staged(single.join(common, "token", "left_semi").join(classes.select("cls", "size", "level"), "cls"), "buckets")
    out = grouped(docs, every.select("doc_id", "n_shingles", "cls"), classes.select("cls", "size", "level", "rep"), posts, n, percent)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=85)
