"""Operator 13: runs of periodic words, found online by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least max(LEAST, 2 q) words that no
neighbouring word extends keeping the period.

Words of a text are appended to a suffix automaton. Its suffix links are a tree whose paths to the root are the suffixes of what has
been read; a link-cut forest divides that tree into paths of one colour, the end of the last occurrence of their strings. Appending word i accesses the path
of the new prefix: the path crosses segments of old colours, is recoloured with i, and the segments it crosses are few (their
number is logarithmic in the mean). A segment of colour e holds the suffixes of some lengths (lo, hi] whose previous occurrence ends at e. If
q = i - e lies in (lo, hi], the last q words equal the q before: a square whose root is no power, as its previous occurrence would then be nearer.
Each such square is extended to its run, unless the last run of that period holds it already.

Words that can't be in a run are left out beforehand, without loss. A run's first L - q and last L - q words (together all of
them, and LEAST / 2 at least, as 2 q <= L) repeat q words on or before, so each of its words lies in a stretch of LEAST / 2 words that occurs twice. Words outside of such
stretches cut the text into parts, again and again while that cuts anything; parts of less than LEAST words go. Hashes may only keep too many.

A text is one task's work, with memory linear in the longest part that repeats. Words are maximal stretches of bytes other than
space and U+0009 to U+000D. Null and empty texts have no words and no runs, and collapse to an empty text. Each row is searched on its own:
repeated rows get equal results, rows without doc_id stay (and are never planted with), an empty table gives an empty result; other columns are ignored, whatever their names.
Runs that share words are all reported, a word goes if any of them drops it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Words of the shortest run.
LEAST = 12
#: Rounds of cutting out words that no run can hold.
CUTS = 16
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RUN = "array<struct<start: long, length: long, period: long>>"


def parts(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of ids that can hold runs."""
    k = LEAST // 2
    at = np.arange(len(ids))
    piece = np.zeros(len(ids), dtype=np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for _ in range(CUTS):
        n = len(at)
        if n < LEAST:
            return []
        # stretches of k words of one piece, without gaps
        whole = (at[k - 1 :] - at[: n - k + 1] == k - 1) & (piece[k - 1 :] == piece[: n - k + 1])
        key = piece[: n - k + 1].astype(np.uint64)
        for j in range(k):
            key = (key ^ mixed[at[j : n - k + 1 + j]]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(31)
        begins = np.flatnonzero(whole)
        _, back, many = np.unique(key[begins], return_inverse=True, return_counts=True)
        begins = begins[many[back] > 1]
        cover = np.zeros(n + 1, dtype=np.int64)
        np.add.at(cover, begins, 1)
        np.add.at(cover, begins + k, -1)
        stays = cover[:n].cumsum() > 0
        new = at[stays]
        broken = np.r_[True, (np.diff(new) > 1) | (np.diff(piece[stays]) > 0)] if len(new) else np.zeros(0, bool)
        label = broken.cumsum()
        long = np.bincount(label)[label] >= LEAST if len(new) else np.zeros(0, bool)
        new, label = new[long], label[long]
        same = len(new) == n and (label[-1] - label[0] == piece[-1] - piece[0] if n else True)
        at, piece = new, label
        if same:
            break
    edge = np.flatnonzero(np.r_[True, np.diff(piece) > 0]) if len(at) else np.zeros(0, int)
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edge, np.r_[edge[1:], len(at)], strict=True)]


class Automaton:
    """Suffix automaton whose suffix links are a link-cut forest coloured by last occurrences; `append` gives the segments it crosses."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0
        # splay trees of the paths: the left side is nearer to the root; `up` of a splay root leads to the path above; its colour counts
        self.left, self.right, self.up, self.colour = [-1], [-1], [-1], [-1]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(-1)
        self.colour.append(-1)
        return len(self.link) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        if y < 0 or (left[y] != x and right[y] != x):
            return
        while y >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z >= 0 and (left[z] == y or right[z] == y)
            turns = ((y, x), (z, x)) if inner and (left[z] == y) != (left[y] == x) else ((z, y), (y, x)) if inner else ((y, x),)
            for a, b in turns:
                # b, a child of a, takes a's place
                c = up[a]
                if left[a] == b:
                    d = left[a] = right[b]
                    right[b] = a
                else:
                    d = right[a] = left[b]
                    left[b] = a
                if d >= 0:
                    up[d] = a
                if c >= 0:
                    if left[c] == a:
                        left[c] = b
                    elif right[c] == a:
                        right[c] = b
                up[b], up[a] = c, b
                self.colour[b] = self.colour[a]
            y = up[x]

    def append(self, word: int, i: int) -> list[tuple[int, int]]:
        """Append word, number i: (longest suffix, end of its previous occurrence) of each segment of the path, longest first."""
        next_, link, length = self.next, self.link, self.length
        cur = self._state(length[self.last] + 1, 0, {})
        p = self.last
        while p >= 0 and word not in next_[p]:
            next_[p][word] = cur
            p = link[p]
        if p >= 0:
            q = next_[p][word]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = self._state(length[p] + 1, link[q], dict(next_[q]))
                while p >= 0 and next_[p].get(word) == q:
                    next_[p][word] = clone
                    p = link[p]
                link[q] = link[cur] = clone
                # the clone's strings last occurred where q's did: it comes next above q on q's path
                self._splay(q)
                above = self.left[q]
                self.left[q], self.up[clone], self.left[clone] = clone, q, above
                if above >= 0:
                    self.up[above] = clone
        self.last = cur
        self.up[cur] = link[cur]
        return self._access(cur, i)

    def _access(self, cur: int, i: int) -> list[tuple[int, int]]:
        left, right, up, colour, length = self.left, self.right, self.up, self.colour, self.length
        crossed, below, x = [], cur, up[cur]
        while x >= 0:
            self._splay(x)
            crossed.append((length[x], colour[x]))
            if right[x] >= 0:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
        self._splay(cur)
        return crossed


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ids, by start, then period."""
    found: list[tuple[int, int, int]] = []
    for a, b in parts(ids):
        part, until = ids[a:b], {}
        words, automaton = part.tolist(), Automaton()
        for i, word in enumerate(words):
            crossed = automaton.append(word, i)
            for k, (hi, end) in enumerate(crossed):
                q = i - end
                if end < 0 or q > hi or (k + 1 < len(crossed) and q <= crossed[k + 1][0]) or until.get(q, 0) > i:
                    continue
                start, stop = _extended(part, i - 2 * q + 1, i + 1, q)
                until[q] = stop
                if stop - start >= LEAST:
                    found.append((a + start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _extended(part: np.ndarray, start: int, stop: int, q: int) -> tuple[int, int]:
    """The square part[start:stop] of period q as far as the period goes both ways, in growing steps."""
    step = 16
    while stop < len(part):
        other = np.flatnonzero(part[stop : stop + step] != part[stop - q : min(stop + step, len(part)) - q])
        if len(other):
            stop += int(other[0])
            break
        stop, step = min(stop + step, len(part)), 2 * step
    step = 16
    while start > 0:
        low = max(0, start - step)
        other = np.flatnonzero(part[low:start] != part[low + q : start + q])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, step = low, 2 * step
    return start, stop


def searched(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period), text: its words without those that runs drop (all of a run's
    but for its first period), joined by one space."""
    bounded_batches(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            all_runs, texts = [], []
            for text in b.column("text").to_pylist():
                words = WORD.findall((text or "").encode())
                number: dict[bytes, int] = {}
                mine = runs(np.fromiter(map(number.setdefault, words, count()), dtype=np.int64, count=len(words)))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                if mine:
                    drop = np.zeros(len(words) + 1, dtype=np.int64)
                    for s, n, q in mine:
                        drop[s + q] += 1
                        drop[s + n] -= 1
                    words = [words[k] for k in np.flatnonzero(drop[:-1].cumsum() == 0)]
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(all_runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "text"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUN}, text string")


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text); every tenth text, by the hash h of its doc_id, goes on with a repeated stretch of its own words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    a = F.pmod(g, F.col("n"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(g, F.lit(8))))

    def word(i: Column) -> Column:
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))

    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.when(F.size("words") > 0, n))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return chosen.withColumn("a", a).withColumn("p", p).select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: The same by all pairs of equal words of a text, as DuckDB's SQL.
ORACLE_SQL = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
hashed as (select *, len(words) as n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) as h from d),
placed as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from hashed),
dealt as materialized (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from placed),
w as materialized (select r, i, words[1 + case when i >= a then a + (i - a) % p else i end] as word from dealt, unnest(range(n)) t(i)),
pairs as (select x.r, x.i, y.i - x.i as q from w x join w y on x.r = y.r and x.word = y.word and x.i < y.i),
places as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs),
stretches as (select r, q, min(i) as start, count(*) + q as length from places group by r, q, island having count(*) + q >= greatest({LEAST}, 2 * q)),
runs as materialized (select r, start, length, min(q) as period from stretches group by r, start, length),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(word, ' ' order by i) as text from w anti join gone using (r, i) group by r),
listed as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
  first(struct_pack(s := start, l := length, q := period) order by length desc, start, period) as best from runs group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.q as period, 1000 * best.l // best.q as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join listed using (r) left join kept using (r)"""
