"""Operator 8: near-duplicate vectors of equal label by product quantisation.

Vectors of length 1 are dealt to coarse lists (nearest of the centroids that k-means finds on a bounded sample); the residual is
coded in PARTS subspaces of CODES centroids each, and the code stands in the list. A query's distance to a coded vector comes from
look-up tables, one per subspace (asymmetric: the query is not coded).

Both filters lose no pair: cosine >= c means a distance of t = sqrt(2 - 2c) at most. A vector of list j lies on j's side of the
plane between the centroids of j and of the query's own list i, so j is probed unless the query is further than t from that plane:
d_j^2 - d_i^2 <= 2 t |c_i - c_j|. And as a vector is e away from its code, a coded distance above t + e rules a pair out. What is
left is reranked by the exact cosine in doubles, so all pairs at THRESHOLD or more are found and none below.

Copies (equal label and direction) are collapsed before, to one node each. Lists of a label are split to blocks of BLOCK vectors and meet
QUERIES queries at a time; vectors move as they are given, with their codes. Only link counts and spanning forests leave a task, never
all pairs: that is why the rerank is done in the block.

Vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing, nor do those
without label. Rows that repeat vec_id, label and vector count once. A vec_id with several vectors has the links of all of them together
(those between its own vectors included) and is one place of the graph: what links to any of them is in one component. An empty
table gives an empty result. Other columns are ignored, whatever their names. There are no ties: all results are counts and minima.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, materialise, matrix, release, spread, whole_groups
from .vectors import dimension, k_means, nearest, sample, stored, unit, usable

THRESHOLD = 0.98
PARTS, CODES = 8, 64
LIST_ROWS, LISTS = 8_000, (4, 256)
BLOCK, QUERIES = 2_048, 2_048


class Quantiser:
    """Coarse centroids, codebooks of the residuals."""

    def __init__(self, x: np.ndarray, lists: int) -> None:
        self.coarse = k_means(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = [p for p in np.array_split(np.arange(x.shape[1]), PARTS) if len(p)]
        self.books = [k_means(rest[:, p], CODES, rounds=6) for p in self.cuts]
        self.gaps = np.sqrt(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(axis=2))

    def encode(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, squared length of the decoded vector, distance from it."""
        rest = x - self.coarse[of]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        back = self.coarse[of].copy()
        for k, (p, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            back[:, p] += b[codes[:, k]]
        return codes, (back**2).sum(axis=1), np.sqrt(((x - back) ** 2).sum(axis=1))

    def products(self, x: np.ndarray, j: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the decoded vectors of list j, from look-up tables."""
        out = np.repeat((x @ self.coarse[j])[:, None], len(codes), axis=1).astype(np.float32)
        for k, (p, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (x[:, p] @ b.T).astype(np.float32)[:, codes[:, k]]
        return out


def _listed(q: Quantiser, dim: int, kind: type, reach: float) -> Callable:
    """Task: each vector as a coded member of its list, and as a query of that list and of all later lists that it can have links in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v"), kind, dim).astype(np.float64))
            d = (x**2).sum(axis=1)[:, None] + (q.coarse**2).sum(axis=1) - 2 * x @ q.coarse.T
            of = d.argmin(axis=1)
            probe = (d - d[np.arange(len(x)), of][:, None] <= 2 * reach * q.gaps[of] + 1e-9) & (np.arange(len(q.coarse)) >= of[:, None])
            row, to = np.nonzero(probe)
            codes, length, error = q.encode(x, of)
            numbers = np.stack([length, error], axis=1)
            coded = pa.array([c.tobytes() + e.tobytes() for c, e in zip(codes, numbers, strict=True)] + [None] * len(row), pa.binary())
            own = np.r_[np.ones(len(x), bool), of[row] == to]
            some = batch.take(pa.array(np.r_[np.arange(len(x)), row]))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("node", "label", "n", "v")), pa.array(np.r_[of, to], pa.int32()), pa.array(own), coded], ["node", "label", "n", "v", "list", "own", "code"])

    return work


def _linked(q: Quantiser, dim: int, kind: type, least: float, reach: float) -> Callable:
    """Task over blocks of members and queries: (a, b, 0) of a spanning forest of the links, (a, null, links) counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group"):
            group, ids, n, lists, own = (np.asarray(t[c]) for c in ("group", "node", "n", "list", "own"))
            asks = ~np.asarray(t["code"].is_valid())
            x = unit(matrix(t["v"], kind, dim).astype(np.float64))
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            a, b, links = [], [], []
            for s, z in zip(at, np.r_[at[1:], len(group)], strict=True):
                ask, member = s + np.flatnonzero(asks[s:z]), s + np.flatnonzero(~asks[s:z])
                if not len(ask) or not len(member):
                    continue
                raw = matrix(t["code"].take(pa.array(member)), np.uint8, len(q.cuts) + 16)
                codes, (length, error) = raw[:, : len(q.cuts)], np.ascontiguousarray(raw[:, len(q.cuts) :]).view(np.float64).T
                bound = (1 + length - (reach + error) ** 2) / 2 - 1e-5
                # in its own list a pair is met once: by the query with the larger node
                may = (q.products(x[ask], int(lists[s]), codes) >= bound) & (~own[ask][:, None] | (ids[ask][:, None] > ids[member][None, :]))
                f, count = Forest(len(ask) + len(member)), np.zeros(z - s, dtype=np.int64)
                for i in np.flatnonzero(may.any(axis=1)).tolist():
                    near = np.flatnonzero(may[i])
                    near = near[(x[member[near]] * x[ask[i]]).sum(axis=1) >= least]
                    if not len(near):
                        continue
                    count[ask[i] - s] += n[member[near]].sum()
                    count[member[near] - s] += n[ask[i]]
                    for k in near.tolist():
                        if f.join(i, len(ask) + k):
                            a.append(ids[ask[i]]), b.append(ids[member[k]]), links.append(0)
                for k in np.flatnonzero(count).tolist():
                    a.append(ids[s + k]), b.append(None), links.append(count[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])

    return work


def near_duplicates(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vec_id: links with other vectors of its label, the smallest vec_id that links
    lead to, and whether it is that."""
    everyone = vectors.select(F.col("vec_id").cast("long")).where("vec_id is not null").distinct()
    alone = everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim, kind = dimension(vectors), stored(vectors)
    if not dim:
        return alone
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding").where("vec_id is not null and label is not null")
    label = f"label {rows.schema['label'].dataType.simpleString()}"
    clean = rows.mapInArrow(usable(dim, ["vec_id", "label"], kind, directions=True), f"vec_id long, {label}, v binary, dir binary")
    clean = materialise(clean.select("vec_id", "label", "v", F.xxhash64("label", "dir").alias("node")))
    members = materialise(clean.select("vec_id", "node").distinct())
    sizes = members.groupBy("node").agg(F.count("*").alias("n"))
    copies = materialise(clean.groupBy("node").agg(F.min("label").alias("label"), F.min("v").alias("v")).join(sizes, "node").select("node", "label", "n", "v"))
    total = copies.count()
    drawn = sample(copies, total, dim, kind, "node")
    if not len(drawn):
        return alone
    q = Quantiser(unit(drawn), min(LISTS[1], max(LISTS[0], total // LIST_ROWS)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    listed = materialise(copies.mapInArrow(_listed(q, dim, kind, reach), f"node long, {label}, n long, v binary, list int, own boolean, code binary"))
    asks = F.col("code").isNull()
    counted = listed.groupBy("label", "list").agg(F.ceil(F.count_if(~asks) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(asks) / QUERIES).cast("int").alias("sets")).where("blocks > 0 and sets > 0")
    pick = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    # a member goes to its block for each set of queries, a query in its set to each block
    other = F.explode(F.when(asks, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("sets") - 1)))
    dealt = listed.join(counted, ["label", "list"]).withColumn("other", other).withColumn(
        "group", F.xxhash64("label", "list", F.when(asks, F.col("other")).otherwise(pick("blocks")), F.when(asks, pick("sets")).otherwise(F.col("other")))
    )
    blocks = spread(dealt.select("group", "node", "n", "v", "list", "own", "code"), "group").sortWithinPartitions("group")
    found = materialise(blocks.mapInArrow(_linked(q, dim, kind, least, reach), "a long, b long, links long"))
    release(listed, copies, clean)
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    # vectors of one vec_id are one place of the graph
    several = members.groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b <> z").select("vec_id", "b")
    ties = members.join(several, "vec_id").select(F.col("node").alias("a"), "b")
    parts = components(found.where("b is not null").select("a", "b").union(ties), "node", "part")
    joined = members.join(counts, "node", "left").join(sizes, "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    first = joined.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    each = joined.join(first, "part").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.min("component_id").alias("component_id"))
    return (
        everyone.join(each, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
