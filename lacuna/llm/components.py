"""Connected components of an undirected graph, by rounds of large-star and small-star.

The least neighbours are written before they are joined, so both sides of a join come from an exchange and the
rows of a node with very many neighbours can be split between tasks (AQE's skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.scratch import materialise, release


def _linked(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge (a, b) as (b, m of a)."""
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b. Links each node's larger neighbours to the least of the node and its neighbours."""
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = materialise(edges.unionByName(up).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    out = materialise(_linked(up, least).filter("a > b").distinct(), "large-stars")
    release(least, edges)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    out = materialise(_linked(edges, least).unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "small-stars")
    release(least, edges)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """A written table: cid, comp for each node of the edges (a, b), the least node that it can reach."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark, before = _mark(edges), None
    while mark[0] and mark != before:
        edges, before = _small_star(_large_star(edges)), mark
        mark = _mark(edges)
    nodes = edges.select(F.col("a").alias("cid"), F.col("b").alias("comp"))
    out = materialise(nodes.unionByName(edges.select(F.col("b").alias("cid"), F.col("b").alias("comp")).distinct()), "labels")
    release(edges)
    return out
