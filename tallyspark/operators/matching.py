"""One-to-one matching in time: every asking row, in input order, takes its best free partner.

That loop has one outcome, and it is the stable matching in which each partner prefers the asking row that comes first in the input. So it can be
found by proposals in any order: an asking row proposes to its best partner that holds no earlier one, a partner that gets an
earlier row lets the later one go, which then proposes on. Partners only ever change to earlier rows.

Rows meet in slices of time. A slice proposes until nothing moves, in order, with a heap of the rows that still ask; it sees
the partners around it too, and a row whose best partner lies outside waits. The next round cuts time in other places, half a slice
on, so that each pair is inside a slice of one of two cuttings; what waited, and what was let go by another slice, proposes there. A round is a
shuffle of the rows, never of pairs, and costs about as many steps as there are rows. The number of rounds depends on how far chains of rows that let each
other go reach over slices, not on the number of days: one where a part's rows fit a slice, else three or so.

Rows of different parts (such as amounts) never meet. Parts of up to SLICE_ROWS rows aren't cut in time but share slices with others, the
rest is cut into slices of SLICE_DAYS days, or four times the span of days that a pair may have. A slice must fit one task.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import materialise, release

#: Rows of a part that meet in one task whatever their dates; days of a slice of larger parts, at least.
SLICE_ROWS, SLICE_DAYS = 500_000, 64

#: More than any number.
GONE = 1 << 63

#: (part, day, cents, owner) of a row, by its number.
Row = tuple[int, int, int, str]
#: Of two days: None if rows of these days can't be a pair, else what counts first: pairs of smaller numbers are better.
Rank = Callable[[int, int], int | None]


class Proposals:
    """Rows of a slice. Subclasses find an asking row's best partner that holds no earlier row; asking rows come in order."""

    def __init__(self, asking: dict[int, Row], partners: dict[int, Row], inside: set[int], holder: dict[int, int]) -> None:
        self.asking, self.partners, self.inside, self.holder = asking, partners, inside, holder

    def best(self, a: int) -> int | None:
        raise NotImplementedError

    def settle(self) -> int:
        """Propose until nothing moves; how many rows are left to other slices."""
        holds, left = set(self.holder.values()), 0
        heap = sorted(a for a in self.asking if a not in holds)
        while heap:
            a = heapq.heappop(heap)
            b = self.best(a)
            if b is None:
                continue
            if b not in self.inside:
                left += 1
                continue
            old = self.holder.get(b)
            self.holder[b] = a
            if old is not None:
                if old in self.asking:
                    heapq.heappush(heap, old)
                else:
                    left += 1
        return left


class EqualParts(Proposals):
    """Partners of the same part and another owner; the best has the smallest rank of days, then the smallest number.

    Each part and day has a queue of partners per owner and a heap of the queues' heads, so that a proposal costs a logarithm."""

    def __init__(self, *rows, days: Callable[[int], list[list[int]]]) -> None:
        super().__init__(*rows)
        self.days = days
        self.queues: dict[tuple[int, int], dict[str, deque[int]]] = {}
        self.heads: dict[tuple[int, int], list[tuple[int, str]]] = {}
        for b in sorted(self.partners):
            part, day, _, owner = self.partners[b]
            self.queues.setdefault((part, day), {}).setdefault(owner, deque()).append(b)
        for key, owners in self.queues.items():
            self.heads[key] = sorted((queue[0], owner) for owner, queue in owners.items())

    def _top(self, key: tuple[int, int], a: int) -> tuple[int, str] | None:
        """The first partner of a day that holds no row before a; those that do are gone for all later rows."""
        heap, queues = self.heads[key], self.queues[key]
        while heap:
            b, owner = heap[0]
            queue = queues[owner]
            while queue and self.holder.get(queue[0], a) < a:
                queue.popleft()
            if queue and queue[0] == b:
                return heap[0]
            if queue:
                heapq.heapreplace(heap, (queue[0], owner))
            else:
                heapq.heappop(heap)
        return None

    def best(self, a: int) -> int | None:
        part, day, _, owner = self.asking[a]
        for equal in self.days(day):
            found = None
            for other in equal:
                key = (part, other)
                if key not in self.heads:
                    continue
                top = self._top(key, a)
                if top and top[1] == owner:
                    mine = heapq.heappop(self.heads[key])
                    top = self._top(key, a)
                    heapq.heappush(self.heads[key], mine)
                if top and (found is None or top[0] < found):
                    found = top[0]
            if found is not None:
                return found
        return None


class MinTree:
    """Smallest number of a range of a list from which numbers go."""

    def __init__(self, numbers: list[int]) -> None:
        self.n = len(numbers)
        self.tree = [GONE] * self.n + numbers
        self.at = {b: i for i, b in enumerate(numbers)}
        for i in range(self.n - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def remove(self, number: int) -> None:
        i = self.at[number] + self.n
        self.tree[i] = GONE
        while i > 1:
            i //= 2
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def least(self, low: int, high: int) -> int:
        found, low, high = GONE, low + self.n, high + self.n
        while low < high:
            if low & 1:
                found = min(found, self.tree[low])
                low += 1
            if high & 1:
                high -= 1
                found = min(found, self.tree[high])
            low, high = low // 2, high // 2
        return found


class NearAmounts(Proposals):
    """Partners within some days whose amount differs by less than a tenth of the larger; the best has the smallest score (days apart, 10 more
    for other amounts, 20 from a twentieth on), then the smallest number. Each day has its partners by amount and the smallest number of
    each range of amounts, so that a proposal costs a logarithm per day."""

    def __init__(self, *rows, most: int) -> None:
        super().__init__(*rows)
        self.offsets = sorted(range(-most, most + 1), key=abs)
        by_day: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for b, (part, day, cents, _) in self.partners.items():
            by_day.setdefault((part, day), []).append((cents, b))
        self.by_day = {key: ([c for c, _ in sorted(found)], MinTree([b for _, b in sorted(found)])) for key, found in by_day.items()}

    def best(self, a: int) -> int | None:
        part, day, cents, _ = self.asking[a]
        found = None
        # amounts from (excluded) to (excluded), and what they add to the score; a wider range holds only others if a narrower one has none
        ranges = ((cents - 1, cents + 1, 0), (19 * cents // 20, -(-20 * cents // 19), 10), (9 * cents // 10, -(-10 * cents // 9), 20))
        for offset in self.offsets:
            if found and found[0] < abs(offset):
                break
            amounts, tree = self.by_day.get((part, day + offset), ((), None))
            for low, high, more in ranges if amounts else ():
                if found and found[0] < abs(offset) + more:
                    break
                low, high = bisect_left(amounts, low + 1), bisect_left(amounts, high)
                while (b := tree.least(low, high)) < GONE and self.holder.get(b, a) < a:
                    tree.remove(b)
                if b < GONE:
                    found = min(found or (GONE, GONE), (abs(offset) + more, b))
                    break
        return found[1] if found else None


def ranked_days(span: int, rank: Rank) -> Callable[[int], list[list[int]]]:
    """From a day to the days of its partners, the best first, equally good ones together."""

    @lru_cache(maxsize=100_000)
    def days(day: int) -> list[list[int]]:
        by: dict[int, list[int]] = {}
        for other in range(day - span, day + span + 1):
            if (r := rank(day, other)) is not None:
                by.setdefault(r, []).append(other)
        return [by[r] for r in sorted(by)]

    return days


def matched(rows: DataFrame, span: int, proposals: Callable[..., Proposals]) -> DataFrame:
    """(a, b): asking rows and the partners that they get.

    rows: part (long), asks (boolean), seq (long, unique), day (int), cents (long), owner (string). span: the days that a pair may be apart, at most. proposals:
    from (asking, partners, inside, holder) to the slice's Proposals."""
    length = max(SLICE_DAYS, 4 * span)
    given = materialise(rows.select("part", "asks", "seq", "day", "cents", "owner"))
    sizes = given.groupBy("part").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if not total["n"]:
        return given.select(F.col("seq").alias("a"), F.col("seq").alias("b")).limit(0)
    cut = total["most"] > SLICE_ROWS
    shares = max(int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["n"] // SLICE_ROWS))
    # slices that many small parts share have negative numbers, those of a large part its own hash
    share = (-1 - F.pmod(F.xxhash64("part"), F.lit(shares))).alias("share")
    if cut:
        large = materialise(sizes.where(F.col("n") > SLICE_ROWS).select("part", F.lit(True).alias("large")))
        given = given.join(F.broadcast(large) if large.count() <= SLICE_ROWS else large, "part", "left")
    else:
        given = given.withColumn("large", F.lit(None).cast("boolean"))
    state = given.withColumn("holder", F.lit(None).cast("long")).withColumn("left", F.lit(0).cast("long"))
    names = ["part", "asks", "seq", "day", "cents", "owner", "large", "holder"]

    def work(table: pa.Table) -> pa.Table:
        asking, partners, inside, holder = {}, {}, set(), {}
        columns = [table.column(c).to_pylist() for c in ("asks", "seq", "part", "day", "cents", "owner", "holder", "here")]
        for asks, seq, part, day, cents, owner, holds, here in zip(*columns, strict=True):
            if asks:
                if here:
                    asking[seq] = (part, day, cents, owner)
                continue
            partners[seq] = (part, day, cents, owner)
            if here:
                inside.add(seq)
            if holds is not None:
                holder[seq] = holds
        left = proposals(asking, partners, inside, holder).settle()
        own = table.filter(table.column("here"))
        held = pa.array([holder.get(s) for s in own.column("seq").to_pylist()], pa.int64())
        own = own.select(names[:-1]).append_column("holder", held)
        return own.append_column("left", pa.array([left] + [0] * (own.num_rows - 1) if own.num_rows else [], pa.int64()))

    shift, held = 0, None
    while True:
        # a large part's row is in its slice, and a partner near a border also in the next one
        at = lambda days: F.floor((F.col("day") + days) / length)
        mine = at(F.lit(shift))
        around = F.array_distinct(F.array(mine, at(F.lit(shift - span)), at(F.lit(shift + span))))
        slices = F.when(F.col("large") & ~F.col("asks"), around).when(F.col("large"), F.array(mine)).otherwise(F.array(F.lit(0).cast("long")))
        met = state.select(*names, mine.alias("mine"), F.explode(slices).alias("slice"))
        met = met.withColumn("here", F.col("large").isNull() | (F.col("mine") == F.col("slice")))
        key = F.when(F.col("large"), F.col("part")).otherwise(share).alias("key")
        kind = "part long, asks boolean, seq long, day int, cents long, owner string, large boolean, holder long, left long"
        new = materialise(met.groupBy(key, F.col("slice"), F.coalesce("large", F.lit(False)).alias("is_large")).applyInArrow(work, kind))
        if held is not None:
            release(held)
        state = held = new
        if not cut or not new.agg(F.sum("left").alias("n")).first()["n"]:
            break
        shift = length // 2 - shift
    return state.where("not asks and holder is not null").select(F.col("holder").alias("a"), F.col("seq").alias("b"))
