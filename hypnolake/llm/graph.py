"""Connected components of an edge table, without gathering a neighbourhood anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least node among u and its neighbours. Minima are combined before the shuffle."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("m", "u").alias("m"))
    return edges.join(low, edges.u == low.u_).drop("u_")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    moved = low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node in ``links`` (u, v), by large and small stars in turn.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(links.select("u", "v").filter("u <> v").distinct())
    seen = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
