"""Texts that many rows have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import materialise

#: Texts that are broadcast, at most.
FEW = 500_000


def with_text(rows: DataFrame, source: str, name: str, derived: Callable[[Column], Column]) -> DataFrame:
    """rows with name: what `derived` makes of the column source, found once for each distinct text (also for null)."""
    texts = materialise(rows.select(F.col(source).alias("__text")).distinct().withColumn(name, derived(F.col("__text"))))
    texts = F.broadcast(texts) if texts.count() <= FEW else texts
    return rows.join(texts, F.col(source).eqNullSafe(F.col("__text")), "left").drop("__text")
