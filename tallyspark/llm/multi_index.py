"""Operator 2: approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky 2012).

The two halves of the vectors are quantised on their own, by K centroids each that k-means finds on a bounded sample; every vector
is indexed in the cell of its two centroids. A query visits cells in the order of their summed distance (how far the product of
a half and its centroid lies below the half's best one), by a heap over the two sorted lists, until they hold SHARE of all
vectors, and k at least. What the cells hold is reranked by the inner product in doubles.

SHARE is set for vectors without any structure, whose neighbours lie in many cells (recall at 20: see README); where vectors are
clustered, much less does. There is no size below which the index is left out.

Neighbouring cells are packed to blocks (of n / partitions vectors, within BLOCKS); larger cells are split. A block meets at most
QUERIES queries at a time, and scores TOGETHER of them at once, so a task's memory is bounded whatever cell is hot. Only the best of
each block leave a task. With queries a fixed part of all rows the work is quadratic.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, as query or
candidate. Rows that repeat a vec_id are candidates of their own, but not of a query with this vec_id; a query's result is given
once, for the smallest of its vectors by their bytes. Ties go to the smaller vec_id. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, matrix, spread, whole_groups
from .vectors import dimension, k_means, nearest, sample, stored, usable

K, SHARE = 160, 0.35
NEAREST, QUERY_STEP = 20, 20
BLOCKS, QUERIES, TOGETHER = (2_048, 16_384), 4_096, 256


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells i * len(second) + j by ascending first[i] + second[j], until they hold enough vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb, ai, bj, width = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist(), len(second)
    heap, out, held = [(fa[0] + sb[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = ai[i] * width + bj[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        # each pair is pushed once: along a row always, to the next row from its first column
        if j + 1 < len(sb):
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(fa):
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))
    return out


def _assign(halves: tuple[np.ndarray, np.ndarray], dim: int, kind: type) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), kind, dim).astype(np.float64)
            cut = halves[0].shape[1]
            cell = nearest(x[:, :cut], halves[0]) * len(halves[1]) + nearest(x[:, cut:], halves[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int64())], ["vec_id", "v", "cell"])

    return work


def _visits(halves: tuple[np.ndarray, np.ndarray], dim: int, kind: type, counts: list[int], enough: int, blocks: np.ndarray, parts: np.ndarray) -> Callable:
    """Task: a query to one row per block that it visits, with the cells that it visits there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), kind, dim).astype(np.float64)
            cut = halves[0].shape[1]
            near = x[:, :cut] @ halves[0].T, x[:, cut:] @ halves[1].T
            rows, to, cells = [], [], []
            for i, (p, q) in enumerate(zip(*near, strict=True)):
                at = np.array(visited(p.max() - p, q.max() - q, counts, enough), dtype=np.int32)
                order = np.argsort(blocks[at], kind="stable")
                at = at[order]
                begin = np.flatnonzero(np.r_[True, np.diff(blocks[at]) != 0]) if len(at) else np.zeros(0, int)
                for a, z in zip(begin, np.r_[begin[1:], len(at)], strict=True):
                    for part in range(parts[at[a]]):
                        rows.append(i), to.append(blocks[at[a]] + part), cells.append(at[a:z].tobytes())
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("v"), pa.array(to, pa.int64()), pa.array(cells, pa.binary())], ["vec_id", "v", "block", "cells"])

    return work


def _ranked(dim: int, kind: type, k: int) -> Callable:
    """Task over blocks of candidates (cells null) and queries: each query's best k in the block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group"):
            group, ids, asks = t["group"].to_numpy(), t["vec_id"].to_numpy(), np.asarray(t["cells"].is_valid())
            x, cell = matrix(t["v"], kind, dim).astype(np.float64), t["cell"].to_numpy()
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            out_query, out_id, out_score = [], [], []
            for a, z in zip(at, np.r_[at[1:], len(group)], strict=True):
                asking, c = a + np.flatnonzero(asks[a:z]), a + np.flatnonzero(~asks[a:z])
                known, of = np.unique(cell[c], return_inverse=True)
                members = x[c]
                for first in range(0, len(asking) if len(c) else 0, TOGETHER):
                    q = asking[first : first + TOGETHER]
                    sought = np.stack([np.isin(known, np.frombuffer(t["cells"][i].as_py(), dtype=np.int32)) for i in q.tolist()])
                    score = x[q] @ members.T
                    score[~sought[:, of] | (ids[q][:, None] == ids[c][None, :])] = -np.inf
                    # everything within rounding of the k-th is computed again in one fixed order, so that equal vectors tie
                    kth = np.partition(score, -k, axis=1)[:, -k] if len(c) > k else np.full(len(q), -np.inf)
                    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
                    row, col = np.nonzero((score >= (kth - slack)[:, None]) & np.isfinite(score))
                    exact = np.concatenate([(x[q[row[i : i + 65536]]] * members[col[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)] or [np.zeros(0)])
                    order = np.lexsort((ids[c[col]], -exact, row))
                    row, col, exact = row[order], col[order], exact[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < k
                    out_query.append(ids[q[row[best]]]), out_id.append(ids[c[col[best]]]), out_score.append(exact[best])
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (out_query, out_id, out_score)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.float64())], ["query_id", "vec_id", "score"])

    return work


def neighbours(vectors: DataFrame, queries: str, k: int = NEAREST, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every vector for which `queries`, a condition on vec_id, holds."""
    result = "query_id long, rank int, vec_id long, score double"
    dim = dimension(vectors)
    if not dim:
        return vectors.sparkSession.createDataFrame([], result)
    kind = stored(vectors)
    clean = materialise(vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null").mapInArrow(usable(dim, ["vec_id"], kind), "vec_id long, v binary"))
    n = clean.count()
    drawn = sample(clean, n, dim, kind)
    if not len(drawn):
        return vectors.sparkSession.createDataFrame([], result)
    cut, centres = dim // 2, min(K, max(1, len(drawn) // 3))
    halves = k_means(drawn[:, :cut], centres), k_means(drawn[:, cut:], centres)
    indexed = materialise(clean.mapInArrow(_assign(halves, dim, kind), "vec_id long, v binary, cell long"))
    counts = [0] * (len(halves[0]) * len(halves[1]))
    for r in indexed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    # cells in order fill blocks; one that is larger than a block has blocks of its own
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = min(BLOCKS[1], max(BLOCKS[0], -(-n // partitions)))
    blocks, parts, at, held = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64), 0, 0
    for cell, count in enumerate(counts):
        if count and held and held + count > block:
            at, held = at + 1, 0
        blocks[cell], parts[cell] = at, max(1, -(-count // block))
        held += count
        if parts[cell] > 1:
            at, held = at + int(parts[cell]), 0
    enough = min(n, max(k, round(share * n)))
    asked = materialise(clean.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    visits = spread(asked, "vec_id").mapInArrow(_visits(halves, dim, kind, counts, enough, blocks, parts), "vec_id long, v binary, block long, cells binary")
    sets = max(1, -(-asked.count() // QUERIES))
    table = vectors.sparkSession.createDataFrame([(c, int(blocks[c]), int(parts[c])) for c in range(len(counts)) if counts[c]], "cell long, first long, parts long")
    held_in = indexed.join(F.broadcast(table), "cell").select(
        "vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"), F.lit(None).cast("binary").alias("cells")
    )
    asking = visits.select("vec_id", "v", F.lit(-1).cast("long").alias("cell"), "block", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int").alias("set"), "cells")
    both = held_in.unionByName(asking).withColumn("group", F.col("block") * sets + F.col("set"))
    found = spread(both.select("group", "vec_id", "v", "cell", "cells"), "group").sortWithinPartitions("group").mapInArrow(_ranked(dim, kind, k), "query_id long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
