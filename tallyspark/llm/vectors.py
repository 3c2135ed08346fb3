"""Vectors as rows of doubles in a binary column, and k-means on a bounded sample."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import matrix

#: Vectors from which an index is learned, at most, chosen by a hash; and where the hash chooses none.
SAMPLE, FEWEST = 20_000, 1_000


def stored(vectors: DataFrame) -> type:
    """The numpy type that holds the components as given."""
    return np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without negative zeros, so that equal directions have equal bytes."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0


def usable(dim: int, keep: list[str], kind: type, directions: bool = False) -> Callable:
    """Task: keep columns and `v`, the components as bytes of kind, of vectors of dim finite components that aren't all zero; directions:
    also `dir`, 128 bits of hash of the unit vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = column.flatten()
            size = np.diff(column.offsets.to_numpy())
            start = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
            ok = (size == dim) & np.asarray(column.is_valid())
            rows = np.flatnonzero(ok)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            x = values[start[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
            with np.errstate(all="ignore"):
                top = np.abs(x).max(axis=1, initial=0)
                fine = np.isfinite(x).all(axis=1) & (top > 0)
            x, rows = x[fine], rows[fine]
            some = batch.take(pa.array(rows))
            more = [pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in unit(x)], pa.binary())] if directions else []
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), *more], [*keep, "v", *(["dir"] if directions else [])])

    return work


def dimension(vectors: DataFrame) -> int:
    """The most frequent length (the smaller of equally frequent ones); vectors of other lengths take no part."""
    rows = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows[0]["d"] if rows else 0


def sample(vectors: DataFrame, n: int, dim: int, kind: type, key: str = "vec_id", most: int = SAMPLE) -> np.ndarray:
    """At most about `most` of n vectors (key, v), in the order of their keys; chosen by a hash of key and vector, so that rows which repeat a key
    are drawn apart. If the hash draws nothing, those of the smallest hashes are taken: only a table without rows gives none."""
    hash_ = F.pmod(F.xxhash64(key, "v", F.lit(2)), F.lit(1_000_000))
    drawn = vectors.where(hash_ < min(1.0, most / max(n, 1)) * 1_000_000).select(key, "v").limit(2 * most).toPandas()
    if drawn.empty:
        drawn = vectors.select(key, "v").orderBy(hash_, key, "v").limit(FEWEST).toPandas()
    rows = drawn.sort_values([key, "v"])
    return matrix(pa.array(rows["v"], pa.binary()), kind, dim).astype(np.float64) if len(rows) else np.zeros((0, dim))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most k centres."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds if len(x) > k else 0):
        of = nearest(x, centres)
        count = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres
