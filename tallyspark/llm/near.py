"""From banded signatures to classes of near-duplicates, without ever emitting all pairs of a bucket.

1. Items that share a band key meet in blocks of at most BLOCK x BLOCK members; signatures are compared there in numpy,
   and only a spanning forest of the plausible pairs leaves the task.
2. The forests' components are the plausible clusters. Each item's own text is brought to its cluster once, and the exact
   similarity of plausible pairs is computed, again in blocks and but for pairs that are joined already.
3. The components of the verified forest are the classes.

A larger bucket or cluster is dealt to more blocks; every pair of its members meets in exactly one of them. A side of a block
holds about BLOCK members, and about BLOCK_BYTES of text where members are texts, so that a task's memory follows the longest
text and not the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, matrix, release, spread, whole_groups

BLOCK, BLOCK_BYTES = 1024, 1 << 20


def dealt(df: DataFrame, key: str, item: str = "item", text: str | None = None) -> DataFrame:
    """df with `block` (long) and `side`: rows of one key meet in one block if they are few (and their texts short), else in the
    blocks of a triangle over its parts. Keys with a single row are left out."""
    size = df.groupBy(key).agg(F.count("*").alias("size"), F.sum(F.octet_length(text) if text else F.lit(0)).alias("bytes")).where("size > 1")
    n = F.least("size", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int")
    return (
        df.join(size, key)
        .withColumn("parts", n)
        .withColumn("side", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("block", F.xxhash64(F.col(key), F.least("side", "other"), F.greatest("side", "other")))
        .withColumn("alone", F.col("side") == F.col("other"))
        .drop("size", "bytes", "parts", "other")
    )


def _groups(t: pa.Table) -> Iterator[slice]:
    k = t["block"].to_numpy()
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    for a, b in zip(at, np.r_[at[1:], len(k)], strict=True):
        if b - a > 1:
            yield slice(int(a), int(b))


def agreeing(sig: np.ndarray) -> np.ndarray:
    """How many places of each pair of signatures agree."""
    out = np.zeros((len(sig), len(sig)), dtype=np.uint8)
    for column in sig.T:
        out += column[:, None] == column[None, :]
    return out


def _may_meet(side: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """In a block of two parts only pairs across them meet; a block of one part has them all."""
    return np.ones((len(side),) * 2, bool) if alone.all() else side[:, None] != side[None, :]


def _blocks(df: DataFrame, columns: list[str], work: Callable, schema: str) -> DataFrame:
    return spread(df.select("block", "side", "alone", *columns), "block").sortWithinPartitions("block").mapInArrow(work, schema)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def plausible(bands: DataFrame, sigs: DataFrame, hashes: int, agree: int) -> DataFrame:
    """(item, cluster) of items that share a band key and at least `agree` of `hashes` signature places with another.

    bands: (key, item) longs. sigs: (item, sig binary of uint32)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            item, side, alone = (t[c].to_numpy() for c in ("item", "side", "alone"))
            sig = matrix(t["sig"], np.uint32, hashes)
            a, b = [], []
            for g in _groups(t):
                x = item[g]
                if len(x) == 2:
                    if (sig[g][0] == sig[g][1]).sum() >= agree:
                        a.append(x[0]), b.append(x[1])
                    continue
                hit = np.triu((agreeing(sig[g]) >= agree) & _may_meet(side[g], alone[g]), 1)
                f = Forest(len(x))
                for i, j in zip(*(v.tolist() for v in np.nonzero(hit)), strict=True):
                    if f.join(i, j):
                        a.append(x[i]), b.append(x[j])
                        if f.parts == 1:
                            break
            yield _edges(a, b)

    return components(_blocks(dealt(bands, "key").join(sigs, "item"), ["item", "sig"], work, "a long, b long"), "item", "cluster")


def verified(clusters: DataFrame, payload: Callable, hashes: int, agree: int, least: float) -> DataFrame:
    """Classes (item, class_id) by exact similarity. clusters: (item, cluster, sig, text).

    payload: from texts to (element ids, weights, text index), sorted by text; similarity: weighted Jaccard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            item, side, alone = (t[c].to_numpy() for c in ("item", "side", "alone"))
            sig = matrix(t["sig"], np.uint32, hashes)
            a, b = [], []
            for g in _groups(t):
                x, n = item[g], g.stop - g.start
                hit = np.triu((agreeing(sig[g]) >= agree) & _may_meet(side[g], alone[g]), 1)
                if not hit.any():
                    continue
                texts = [v.encode() for v in t["text"][g.start : g.stop].to_pylist()]
                ids, weight, of = payload(texts)
                known, ids = np.unique(ids, return_inverse=True)
                at = np.searchsorted(of, np.arange(n + 1))
                total = np.add.reduceat(np.r_[weight, 0.0], at[:-1]) * (at[1:] > at[:-1])
                here, f = np.zeros(len(known)), Forest(n)
                for i in range(n):
                    if not len(with_i := np.flatnonzero(hit[i])):
                        continue
                    mine = slice(at[i], at[i + 1])
                    here[ids[mine]] = weight[mine]
                    for j in with_i.tolist():
                        if f.root(i) == f.root(j):
                            continue
                        its = slice(at[j], at[j + 1])
                        both = np.minimum(weight[its], here[ids[its]]).sum()
                        if both >= least * (total[i] + total[j] - both) - 1e-9 and both > 0:
                            f.join(i, j)
                            a.append(x[i]), b.append(x[j])
                    here[ids[mine]] = 0
                    if f.parts == 1:
                        break
            yield _edges(a, b)

    return components(_blocks(dealt(clusters, "cluster", text="text"), ["item", "sig", "text"], work, "a long, b long"), "item", "class_id")


def near_classes(bands: DataFrame, sigs: DataFrame, texts: Callable, payload: Callable, hashes: int, agree: int, least: float) -> DataFrame:
    """(item, class_id) of all items that have a near-duplicate. texts: from a table of plausible items to (item, text)."""
    clusters = plausible(bands, sigs, hashes, agree)
    out = verified(clusters.join(sigs, "item").join(texts(clusters.select("item")), "item"), payload, hashes, agree, least)
    release(clusters)
    return out
