"""Operator 12: product codes of vectors, their codebooks learned by exact integer k-means over metric trees.

Components are integers floor(SCALE * x). Vectors are cut into PARTS equal parts; each part position has a codebook of up to ENTRIES
entries, which starts as the parts of the smallest vec_ids and is improved by ROUNDS rounds: each part goes to its nearest entry
(ties to the lower index), each entry becomes its parts' floored mean, unused entries stay. Then parts are assigned a last time.

Rows meet in blocks of at most BLOCK, as they come. A block has a metric tree per part, built middle-out once: about the square root of
its points become anchors, each the farthest point of the widest anchor before it, taking over the points that are nearer to it (no
point is looked at whose distance to its anchor is at most half of that between both anchors). Anchors' balls are joined upwards, two at a time, those first
whose common ball is smallest, and divided downwards in the same way to leaves of LEAF points. Balls cache centre, radius, sums and counts.
Trees are a table in the shared folder, which each round reads once.

A round goes down all trees of a block level by level. A ball inherits its parent's candidate entries and strikes those that are farther than
its best one at each of its points: |m-c|^2 - |m-b|^2 > 2 r |b-c| for centre m and radius r, with a margin for rounding. A ball with
one candidate is wholly owned: its cached sums and count are the entry's. Points of leaves are compared with the remaining candidates in integers, so results
are those of plain k-means, to the last digit. What leaves a task are sums per part, entry and component: 16 x dimensions rows.

Vectors that are null, empty or hold null or non-finite components take no part, nor do those of another length than most (the smaller
of equally frequent lengths); that length must be a multiple of PARTS. Fewer than ENTRIES vectors make smaller codebooks. Rows that share a
vec_id are rows of their own; of equal vec_ids the smaller vector starts a codebook first, null ids come last. Components may have any size: beyond 2^26 a
block computes with integers of any length, and an error that no long holds is null. An empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fitting, materialise, release
from .vectors import dimension

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Points of a leaf; rows of a block, at most, and bytes of its vectors.
LEAF, BLOCK, BLOCK_BYTES = 64, 8192, 8 << 20
#: From here on squared distances might not fit 64 bits, for parts of up to 64 components.
WIDE = 1 << 26


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers or, where one is WIDE or more, as Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x.astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) < WIDE and x.shape[-1] <= 64:
        return scaled.astype(np.int64)
    # beyond 2^52 a double is an integer itself
    return np.array([int(v) * SCALE if abs(v) >= 1 << 52 else int(np.floor(v * SCALE)) for v in x.ravel().astype(np.float64)] + [0], dtype=object)[:-1].reshape(x.shape)


@dataclass
class Trees:
    """The trees of a block: one row per ball, parents before children, in levels; `order` lists each part's points so that a ball holds a range."""

    order: np.ndarray  # (PARTS, n)
    part: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    start: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Trees:
        with np.load(io.BytesIO(data)) as z:
            return cls(**z)


def _squares(d: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", d, d)


def anchors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each point of x the number of its anchor, and the anchors' points. Less than k anchors if points are equal."""
    at = [int(np.lexsort(x.T)[0])]
    owner = np.zeros(len(x), dtype=np.int64)
    far = np.sqrt(_squares(x - x[at[0]]))
    while len(at) < k:
        new = int(far.argmax())
        if far[new] == 0:
            break
        apart = np.sqrt(_squares(x[at] - x[new]))
        may = np.flatnonzero(far > apart[owner] / 2)
        d = np.sqrt(_squares(x[may] - x[new]))
        won = may[d < far[may]]
        far[won], owner[won] = d[d < far[may]], len(at)
        at.append(new)
    return owner, x[at]


def joined(centre: np.ndarray, radius: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Pairs of balls to join, upwards: (a, b) makes the ball with the next number. Always the pair with the smallest common ball."""
    n = len(radius)
    c, r = np.zeros((2 * n - 1, centre.shape[1])), np.zeros(2 * n - 1)
    c[:n], r[:n] = centre, radius
    cost = np.full((2 * n - 1,) * 2, np.inf)
    common = lambda i, js: np.maximum((np.sqrt(_squares(c[js] - c[i])) + r[js] + r[i]) / 2, np.maximum(r[js], r[i]))
    for i in range(1, n):
        cost[i, :i] = common(i, np.arange(i))
    alive, pairs = list(range(n)), []
    for new in range(n, 2 * n - 1):
        i, j = (int(v) for v in np.unravel_index(cost[:new, :new].argmin(), (new, new)))
        d = np.sqrt(((c[i] - c[j]) ** 2).sum())
        r[new] = cost[i, j]
        t = 0.5 if d == 0 else min(1.0, max(0.0, (r[new] - r[i]) / d))
        c[new] = c[i] + t * (c[j] - c[i])
        pairs.append((i, j))
        cost[[i, j], :] = np.inf
        cost[:, [i, j]] = np.inf
        alive = [a for a in alive if a not in (i, j)]
        if alive:
            cost[new, alive] = common(new, np.array(alive))
        alive.append(new)
    return pairs, 2 * n - 2


def grown(v: np.ndarray) -> Trees:
    """Trees of the parts of a block; v: (n, PARTS, width) integers."""
    n = len(v)
    rows: list[tuple[int, int, int, int, int, bool]] = []  # part, parent, level, start, end, leaf
    order = np.zeros((PARTS, n), dtype=np.int32)
    for p in range(PARTS):
        x, done = None if v.dtype == object else v[:, p].astype(np.float64), 0
        todo = [(np.arange(n), -1, 0, None)]
        while todo:
            points, parent, level, tree = todo.pop()
            if tree is None and len(points) > LEAF and v.dtype != object:
                owner, at = anchors(x[points], max(2, round(len(points) ** 0.5)))
                if len(at) > 1:
                    balls = [points[owner == k] for k in range(len(at))]
                    pairs, top = joined(at, np.array([np.sqrt(_squares(x[b] - a).max()) for a, b in zip(at, balls, strict=True)]))
                    tree = (balls, pairs, top)
            me = len(rows)
            rows.append((p, parent, level, done, done + len(points), tree is None))
            if tree is None:
                order[p, done : done + len(points)] = points
                done += len(points)
                continue
            balls, pairs, top = tree
            for child in reversed(pairs[top - len(balls)]):
                if child < len(balls):
                    todo.append((balls[child], me, level + 1, None))
                else:
                    below, stack = [], [child]
                    while stack:
                        c = stack.pop()
                        if c < len(balls):
                            below.append(balls[c])
                        else:
                            stack.extend(pairs[c - len(balls)])
                    todo.append((np.concatenate(below), me, level + 1, (balls, pairs, child)))
    part, parent, level, start, end, leaf = (np.array(c) for c in zip(*rows, strict=True))
    centre, radius = np.zeros((len(rows), v.shape[2])), np.zeros(len(rows))
    sums = np.zeros((len(rows), v.shape[2]), dtype=np.int64)
    for p in range(PARTS):
        mine = np.flatnonzero(part == p)
        if v.dtype == object:
            radius[mine] = np.inf
            continue
        pts = v[order[p], p]
        x = pts.astype(np.float64)
        total = np.concatenate([np.zeros((1, v.shape[2]), np.int64), pts.cumsum(axis=0)])
        sums[mine] = total[end[mine]] - total[start[mine]]
        centre[mine] = sums[mine] / (end - start)[mine][:, None]
        for deep in range(int(level[mine].max()) + 1):
            here = mine[level[mine] == deep]
            many = (end - start)[here]
            begins = many.cumsum() - many
            points = np.arange(many.sum()) + np.repeat(start[here] - begins, many)
            radius[here] = np.sqrt(np.maximum.reduceat(_squares(x[points] - np.repeat(centre[here], many, axis=0)), begins))
    return Trees(order, part, parent, level, start, end, leaf, centre, radius, sums)


def assigned(v: np.ndarray, trees: Trees, books: list[np.ndarray]) -> tuple[np.ndarray, list, list]:
    """Entry of each part (PARTS, n), and the sums (entries x width) and counts of each codebook's entries, from the balls that are
    wholly owned and the points of the rest."""
    entries, width = max(len(b) for b in books), v.shape[2]
    exact = object if v.dtype == object or any(b.dtype == object for b in books) else np.int64
    code = np.zeros((PARTS, len(v)), dtype=np.int64)
    sums, counts = [np.zeros((entries, width), dtype=exact) for _ in range(PARTS)], [np.zeros(entries, dtype=np.int64) for _ in range(PARTS)]
    book = np.stack(books)
    # with integers of any length every candidate stays
    near = np.zeros(book.shape) if exact is object else book.astype(np.float64)
    gap = np.sqrt(_squares(near[:, :, None] - near[:, None]))
    # an entry that equals an earlier one gets nothing, as ties go to the lower index
    first = np.array([[not (b[:e] == b[e]).all(axis=1).any() for e in range(entries)] for b in book])
    may = np.zeros((len(trees.part), entries), bool)
    with np.errstate(all="ignore"):
        size = max(np.abs(near).max(initial=0), 0 if exact is object else np.abs(v).max(initial=0))
        margin = 1e-9 * size * size
        for level in range(int(trees.level.max(initial=-1)) + 1):
            i = np.flatnonzero(trees.level == level)
            up = trees.parent[i]
            mine = first[trees.part[i]] if level == 0 else may[up]
            i, mine = (i, mine) if level == 0 else (i[mine.any(axis=1)], mine[mine.any(axis=1)])
            if not len(i):
                break
            p = trees.part[i]
            d = _squares(near[p] - trees.centre[i][:, None])
            best = np.where(mine, d, np.inf).argmin(axis=1)
            at = np.arange(len(i))
            mine &= ~(d - d[at, best][:, None] > 2 * trees.radius[i][:, None] * gap[p, best] + margin)
            one = mine.sum(axis=1) == 1
            for k in np.flatnonzero(one):
                b, e = i[k], best[k]
                sums[p[k]][e] += trees.sums[b]
                counts[p[k]][e] += trees.end[b] - trees.start[b]
                code[p[k], trees.order[p[k], trees.start[b] : trees.end[b]]] = e
            may[i] = mine & ~one[:, None]
    for q in range(PARTS):
        open_ = np.flatnonzero(trees.leaf & (trees.part == q) & may.any(axis=1))
        if not len(open_):
            continue
        points = np.concatenate([trees.order[q, trees.start[b] : trees.end[b]] for b in open_])
        row, entry = np.nonzero(np.repeat(may[open_], (trees.end - trees.start)[open_], axis=0))
        d = ((v[points[row], q] - book[q][entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero(d == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        won = entry[hit[np.r_[True, row[hit[1:]] != row[hit[:-1]]]]]
        code[q, points] = won
        np.add.at(sums[q], won, v[points, q])
        np.add.at(counts[q], won, 1)
    return code, sums, counts


def blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, label (arrays), v (doubles as bytes), trees (binary): one row per block."""
    bounded_batches(vectors)
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, n = [], [], [], 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(held)
            trees = grown(integers(x).reshape(len(x), PARTS, -1)).dump()
            arrays = [pa.concat_arrays(c) for c in (ids, labels)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
            return pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary()), pa.array([trees], pa.binary())], ["vec_id", "label", "v", "trees"])

        for b in batches:
            for k in range(0, b.num_rows, most):
                part = b.slice(k, most)
                column = part.column("embedding")
                size = column.value_lengths().fill_null(-1).to_numpy()
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
                begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
                rows = np.flatnonzero(size == dim)
                x = flat[begin[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
                fine = np.isfinite(x).all(axis=1)
                x, rows = x[fine], pa.array(rows[fine])
                if n and n + len(x) > most:
                    yield block()
                    ids, labels, held, n = [], [], [], 0
                if len(x):
                    ids.append(part.column("vec_id").take(rows))
                    labels.append(part.column("label").take(rows))
                    held.append(x)
                    n += len(x)
        if n:
            yield block()

    kinds = [f"{c} array<{vectors.schema[c].dataType.simpleString()}>" for c in ("vec_id", "label")]
    dealt = vectors.select("vec_id", "label", "embedding").repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(work, f"{', '.join(kinds)}, v binary, trees binary")


def _opened(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Trees]]:
    for b in batches:
        for k in range(b.num_rows):
            x = np.frombuffer(b.column("v")[k].as_py(), dtype=np.float64).reshape(-1, dim)
            yield b.slice(k, 1), integers(x).reshape(len(x), PARTS, -1), Trees.load(b.column("trees")[k].as_py())


def _integer_books(books: list[list[list[int]]]) -> list[np.ndarray]:
    wide = any(abs(x) >= WIDE for b in books for e in b for x in e) or len(books[0][0]) * PARTS > 64 * PARTS
    return [np.array(b, dtype=object if wide else np.int64) for b in books]


def improved(trees: DataFrame, books: list[list[list[int]]], dim: int) -> list[list[list[int]]]:
    """Codebooks after one round."""
    width = dim // PARTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], list[int]] = {}
        arrays = _integer_books(books)
        for _, v, t in _opened(batches, dim):
            _, sums, counts = assigned(v, t, arrays)
            for p in range(PARTS):
                for e in np.flatnonzero(counts[p]).tolist():
                    count[p, e] = count.get((p, e), 0) + int(counts[p][e])
                    old = total.get((p, e), [0] * width)
                    total[p, e] = [a + int(b) for a, b in zip(old, sums[p][e], strict=True)]
        # numbers of any length travel as a high and a low part, which sum apart
        rows = [(p, e, i, count[p, e], *divmod(total[p, e][i], 1 << 31)) for p, e in count for i in range(width)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        high = pa.array([f"{h}" for h in columns[4]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]] + [high, pa.array(columns[5], pa.int64())], ["part", "entry", "place", "n", "high", "low"])

    sums = trees.mapInArrow(work, "part long, entry long, place long, n long, high string, low long").groupBy("part", "entry", "place")
    fits = F.length("high") <= 28
    rows = sums.agg(
        F.sum("n").alias("n"), F.sum(F.when(fits, F.col("high").cast("decimal(38,0)"))).alias("high"), F.sum("low").alias("low"), F.collect_list(F.when(~fits, F.col("high"))).alias("giants")
    ).collect()
    out = [[list(e) for e in b] for b in books]
    for r in rows:
        out[r["part"]][r["entry"]][r["place"]] = ((int(r["high"] or 0) + sum(int(g) for g in r["giants"])) * (1 << 31) + r["low"]) // r["n"]
    return out


def coded(trees: DataFrame, books: list[list[list[int]]], dim: int) -> DataFrame:
    """vec_id, label, code, error of all vectors."""
    kinds = {c: trees.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _integer_books(books)
        for b, v, t in _opened(batches, dim):
            code, _, _ = assigned(v, t, arrays)
            error = sum(((v[:, p] - arrays[p][code[p]]) ** 2).sum(axis=1) for p in range(PARTS))
            texts = ["".join(f"{e:02x}" for e in row) for row in code.T.tolist()]
            errors = [e if e < 1 << 63 else None for e in map(int, error)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").flatten(), b.column("label").flatten(), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def first_books(vectors: DataFrame, dim: int) -> list[list[list[int]]]:
    """The parts of the ENTRIES smallest vec_ids."""
    fine = f"size(embedding) = {dim} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.where(fine).select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(-1, dim)
    return [[[int(c) for c in e] for e in integers(x)[:, p * dim // PARTS : (p + 1) * dim // PARTS]] for p in range(PARTS)]


def compressed(vectors: DataFrame) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error) of all vectors, and the codebooks by part, entry, place."""
    dim = dimension(vectors)
    books = first_books(vectors, dim) if dim else [[] for _ in range(PARTS)]
    if not books[0]:
        empty = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        return empty, books
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    trees = materialise(blocks(vectors, dim))
    for _ in range(ROUNDS):
        books = improved(trees, books, dim)
    codes = materialise(coded(trees, books, dim))
    release(trees)
    return codes, books


def with_label_errors(codes: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """vec_id, code, error, label_error (null where no long holds it), codebooks_sha256."""
    whole = ",".join(str(x) for b in books for e in b for x in e)
    total = F.when(F.count("*") == F.count("error"), F.try_sum("error"))
    errors = fitting(codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")))
    return codes.join(errors, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(whole.encode()).hexdigest()).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same by all distances, as DuckDB's SQL."""
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"select p.r, p.part, min(struct_pack(d := {distance}, e := b.entry)) as best from parts p join b{{k}} b on p.part = b.part group by all"
    steps = [
        "finite as (select *, len(embedding) as n from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "most as (select len(embedding) as n from embeddings where len(embedding) > 0 group by 1 order by count(*) desc, 1 limit 1)",
        f"kept as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v, n // {PARTS} as w from finite where n = (select n from most))",
        f"parts as materialized (select r, part, v[part * w + 1 : (part + 1) * w] as v from kept, range({PARTS}) t(part))",
        f"b0 as materialized (select part, r - 1 as entry, v from parts where r <= {ENTRIES})",
    ]
    for k in range(ROUNDS):
        steps += [
            f"a{k} as materialized ({nearest.format(k=k)})",
            f"s{k} as (select part, a.best.e as entry, i, sum(v[i]) as s, count(*) as c from a{k} a join parts using (r, part), range(1, (select any_value(w) from kept) + 1) t(i) group by all)",
            f"m{k} as (select part, entry, list(cast((s - (((s % c) + c) % c)) // c as bigint) order by i) as v from s{k} group by all)",
            f"b{k + 1} as materialized (select part, entry, coalesce(m.v, b.v) as v from b{k} b left join m{k} m using (part, entry))",
        ]
    return f"""with {", ".join(steps)}, last as ({nearest.format(k=ROUNDS)}),
codes as (select r, string_agg(printf('%02x', best.e), '' order by part) as code, cast(sum(best.d) as bigint) as error from last group by r),
book as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from codes join kept using (r), book"""
