"""Small helpers that every operator of this subpackage shares, with those of the library that it uses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, materialise, release, shared_dir

__all__ = ["Forest", "bounded_batches", "components", "fitting", "fresh", "materialise", "matrix", "release", "shared_dir", "spread", "table", "whole_groups"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 500_000


def fitting(df: DataFrame) -> DataFrame:
    """df, broadcast where it has been counted to have no more than BROADCAST_ROWS rows; else joins shuffle both sides."""
    table = materialise(df)
    if table.count() > BROADCAST_ROWS:
        return table
    out = F.broadcast(table)
    out.scratch_path = table.scratch_path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


#: Bytes of an Arrow batch between Spark and Python, where the session leaves it open: rows can be long texts or pages.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> None:
    """Batches for Python are bounded by bytes, not only by rows; a bound that the session sets stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to as many partitions as shuffles have. They aren't merged by their bytes, which say little about the
    work that is done for a row in Python."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold only whole groups, from batches whose equal keys stand together. A group is bounded by its maker."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        k = t[key].to_numpy()
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None:
        yield held


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


class Forest:
    """Union-find over 0..n-1 for the few thousand members of one block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.parts = n

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were joined before."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.parts -= 1
        return True
