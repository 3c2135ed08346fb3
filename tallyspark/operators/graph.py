"""Components of a graph as Spark jobs, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Minima that a round of `components` broadcasts at most.
STAR_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one where that is unset (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tallyspark.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tally-")
        spark.conf.set("spark.tallyspark.shared.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/tally-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no later job reads. What is a part of a returned result stays."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (u, v), u > v, there are, and whether each u has one and no v is another's u: then the components are found."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = nodes.agg(F.sum("up").alias("n"), F.count_if(F.expr("up > 1 or up > 0 and down > 0")).alias("other")).first()
    return row["n"] or 0, row["other"] == 0


def components(edges: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) longs; component: its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Minima are aggregated before the shuffle and
    brought back by a join: broadcast where the edges are counted to be few, else as a table of their own, so that the join of a node
    with very many neighbours can be split.
    Self-loops and repeated edges are allowed. An empty table gives an empty result. edges is computed once.
    """
    given = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e, held = given.where("u <> v"), []
    n, done = _stars(e)

    def minima(df: DataFrame) -> DataFrame:
        if 2 * n <= STAR_ROWS:
            return F.broadcast(df)
        held.append(materialise(df))
        return held[-1]

    while not done:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        least = minima(own)
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        old, held = held, []
        e = materialise(small)
        release(*old)
        held.append(e)
        n, done = _stars(e)
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    alone = given.where("u = v").select(F.col("u").alias("node")).join(found, "node", "left_anti")
    out = materialise(found.union(alone.select("node", "node")).toDF(node, component))
    release(given, *held)
    return out
