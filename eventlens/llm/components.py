"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import storage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and all its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b")))


def _is_done(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none of its own: only stars are left."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    roles = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``node, component`` for each node of ``edges`` (``a, b``) but the least of each component.

    The component is its least node. Edges may repeat and stand either way round; loops and
    edges with a null end are left out; no edges give no rows. Only ever as many rows as edges
    are held, a node's neighbours are never gathered, and each round is written to the shared
    folder, so the lineage stays short.
    """
    spark = edges.sparkSession
    now, path = storage.written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges", tasks,
    )
    while not _is_done(now):
        after, to = storage.written(_small_star(_large_star(now)).distinct(), "edges", tasks)
        storage.drop(spark, path)
        now, path = after, to
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
