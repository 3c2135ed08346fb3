"""Operator 4: near-duplicate documents by improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles.

The weight of a five-word shingle is how often the text has it times the mean inverse document frequency of its words. The
frequencies are counted over all documents in a hashed table of WORD_BUCKETS counters, whose size doesn't grow with the data
(words that share a counter share a frequency). HASHES consistent samples per text are banded, and what collides is verified
by exact weighted Jaccard similarity, THRESHOLD or more. Identical texts are collapsed beforehand.

Null texts and texts without words match nothing. Rows that share a doc_id count as one document: if their texts differ, it belongs
to the class of each of them. Texts are told apart by 128 bits of hash, and are nodes of the graph by 64 bits (with n texts, two share
a node with a probability of n^2 / 2^65). Ties (equal weights of samples) go to the smaller code, so results don't depend on the run. Very
long texts count whole. Columns other than doc_id and text are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, components, fitting, fresh, materialise, release
from .near import near_classes
from .shingles import SHINGLE, bounds, byte_slices, distinct, mix, shingles, words

THRESHOLD = 0.8
BANDS, ROWS = 10, 3
HASHES = BANDS * ROWS
#: Signature places that must agree before the exact test; of 30, a pair at 0.8 has fewer with a probability of 0.001.
AGREE = 17
WORD_BUCKETS = 1 << 16
_U = np.uint64
_rng = np.random.default_rng(20)
#: The random variables of the sampling, indexed by 16 bits of a shingle's hash: r and c are Gamma(2, 1), beta is uniform.
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_PER_R = (1 / _R).astype(np.float32)
_BETA = _rng.random(1 << 16).astype(np.float32)
_LN_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_ODD = _rng.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)


def word_frequencies(docs: DataFrame, buckets: int = WORD_BUCKETS) -> tuple[np.ndarray, int]:
    """Documents that have a word of each bucket, and documents with words, counted over all of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, dtype=np.int64), 0
        for batch in batches:
            for _, _, texts in byte_slices(batch.column(0)):
                h, of, _, _ = words(texts)
                pair = np.unique(of.astype(_U) * _U(buckets) + h % _U(buckets))
                total += np.bincount((pair % _U(buckets)).astype(np.int64), minlength=buckets)
                n += len(np.unique(of))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], n])], ["bucket", "n"])

    rows = docs.where("text is not null").select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    known = dict(zip(rows["bucket"].tolist(), rows["n"].tolist(), strict=True))
    n = known.pop(-1, 0)
    out = np.zeros(buckets)
    out[list(known)] = list(known.values())
    return out, n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    """1 + ln((1 + n) / (1 + df)) of every bucket."""
    return (1 + np.log((1 + n) / (1 + np.minimum(counts, n)))).astype(np.float32)


def weighted(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, weights and text index, sorted by text."""
    h, of, _, _ = words(texts)
    sh, group = shingles(h, of)
    each = idf[(h % _U(len(idf))).astype(np.int64)].astype(np.float64)
    count = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), int)
    n = np.minimum(count[group], SHINGLE)
    sums = np.r_[0.0, np.cumsum(each)]
    first = np.searchsorted(of, group) + np.arange(len(group)) - np.searchsorted(group, group)
    ids, group, tf, at = distinct(sh, group)
    i = first[at]
    return ids, tf * (sums[i + n[at]] - sums[i]) / n[at], group


def signatures(ids: np.ndarray, weight: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Consistent samples of each text with shingles: matrix of 32-bit codes of (shingle, step), and the texts' indexes."""
    at = bounds(group, n)
    full = np.flatnonzero(at[1:] > at[:-1])
    out = np.zeros((len(full), HASHES), dtype=np.uint32)
    if not len(full):
        return out, full
    ln_w = np.log(weight).astype(np.float32)
    low = mix(ids) & _U(0xFFFFFFFF)
    for k in range(HASHES):
        u = (ids ^ (ids >> _U(29))) * _ODD[k]
        i = (u >> _U(48)).astype(np.int64)
        r = _R[i]
        t = np.floor(ln_w * _PER_R[i] + _BETA[i])
        ln_a = _LN_C[((u >> _U(32)) & _U(0xFFFF)).astype(np.int64)] - r * (t - _BETA[i] + np.float32(1))
        # the least a wins, ties to the smaller code: a's bits above the code's, so that one minimum finds both
        code = low ^ (t.astype(np.int64).astype(_U) * _U(0x9E3779B1) & _U(0xFFFFFFFF))
        packed = np.exp(ln_a).view(np.uint32).astype(_U) << _U(32) | code
        out[:, k] = np.minimum.reduceat(packed, at[full]).astype(np.uint32)
    return out, full


def sign(idf: np.ndarray) -> Callable:
    """Task: (doc_id, text, item) to (doc_id, item, copy_of: 128 bits of the exact text, sig or null if there are no words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in byte_slices(batch.column(1)):
                sig, full = signatures(*weighted(texts, idf), b - a)
                raw, sigs = sig.tobytes(), [None] * (b - a)
                for row, i in enumerate(full.tolist()):
                    sigs[i] = raw[row * 4 * HASHES : (row + 1) * 4 * HASHES]
                same = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(same, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "item", "copy_of", "sig"])

    return work


def band_keys(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, item): one row per band of each signature, without touching Python."""
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (4 * rows) + 1, F.lit(4 * rows))))
    return sigs.select("item", F.explode(each).alias("key")).select("key", "item")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_copies, kept): class_id is the smallest doc_id that near-duplicate or equal texts lead to; n_copies
    counts the documents with exactly this text; kept is true for the one document of each class that stays."""
    bounded_batches(docs)
    counts, n = word_frequencies(docs)
    idf = inverse_frequencies(counts, n)
    own = docs.where("text is not null and doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("item"))
    signed = materialise(own.mapInArrow(sign(idf), "doc_id long, item long, copy_of binary, sig binary"))
    texts = materialise(signed.groupBy("copy_of").agg(F.first("item").alias("item"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.count_distinct("doc_id").alias("n_copies")))
    sigs = materialise(texts.where("sig is not null").groupBy("item").agg(F.min("sig").alias("sig")))
    found = near_classes(band_keys(sigs), sigs, lambda some: own.join(fitting(some), "item", "left_semi").groupBy("item").agg(F.min("text").alias("text")), lambda t: weighted(t, idf), HASHES, AGREE, threshold)
    several = materialise(signed.where("sig is not null").groupBy("doc_id").agg(F.min("item").alias("a"), F.max("item").alias("z")).where("a <> z").select("doc_id"))
    if not several.isEmpty():  # texts of one doc_id belong together
        ties = signed.where("sig is not null").join(several, "doc_id").select("doc_id", "item")
        ties = ties.join(ties.groupBy("doc_id").agg(F.min("item").alias("b")), "doc_id").select(F.col("item").alias("a"), "b")
        found = components(found.toDF("a", "b").union(ties), "item", "class_id")
    least = texts.join(found, "item").groupBy("class_id").agg(F.min("doc_id").alias("first"))
    named = found.join(least, "class_id").select("item", F.col("first").alias("class_id"))
    classes = texts.join(named, "item", "left").select("copy_of", "n_copies", F.when(F.col("sig").isNull(), None).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"))
    per_doc = signed.select("doc_id", "copy_of").join(classes, "copy_of").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_copies").alias("n_copies"))
    release(sigs, several)
    return (
        docs.select("doc_id").distinct().join(per_doc, "doc_id", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, once; rows without doc_id stay.

    Of rows that share a doc_id the first by a hash of the whole row stays; only such rows are shuffled."""
    known = docs.where("doc_id is not null")
    kept = near_duplicates(known, threshold).where("kept").select("doc_id")
    left = known.join(kept, "doc_id", "left_semi").select(docs.columns)
    several = fitting(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    nth = fresh(docs, "nth")
    first = left.join(several, "doc_id", "left_semi").withColumn(nth, F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))).where(F.col(nth) == 1).select(docs.columns)
    return left.join(several, "doc_id", "left_anti").select(docs.columns).union(first).union(docs.where("doc_id is null"))
