"""Topological-overlap distance of sparse edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.storage import materialise


def neighbours(edges: DataFrame, value: str = "adj") -> DataFrame:
    """(u, v, a): every edge from both ends."""
    return edges.select(F.col("i").alias("u"), F.col("j").alias("v"), F.col(value).alias("a")).unionAll(
        edges.select(F.col("j").alias("u"), F.col("i").alias("v"), F.col(value).alias("a"))
    )


def strength(edges: DataFrame, value: str = "adj") -> DataFrame:
    """(u, k, degree): sum of adjacency over the edges of a node."""
    return neighbours(edges, value).groupBy("u").agg(F.sum("a").alias("k"), F.count("*").alias("degree"))


def shared(edges: DataFrame, nodes: DataFrame, value: str = "adj") -> DataFrame:
    """(i, j, s): sum of a_iv * a_jv over common neighbours v; edges without any are absent.

    Each edge is extended from its end of smaller degree, so a hub's
    neighbours are looked up, not listed, once for each of its edges.
    """
    nbr = neighbours(edges, value)
    sized = edges.select("i", "j").join(nodes.select(F.col("u").alias("i"), F.col("degree").alias("di")), "i").join(
        nodes.select(F.col("u").alias("j"), F.col("degree").alias("dj")), "j"
    )
    small = F.col("di") <= F.col("dj")
    ends = sized.select("i", "j", F.when(small, F.col("i")).otherwise(F.col("j")).alias("p"), F.when(small, F.col("j")).otherwise(F.col("i")).alias("q"))
    wedges = ends.join(nbr.select(F.col("u").alias("p"), "v", F.col("a").alias("ap")), "p").where("v <> q")
    closed = wedges.join(nbr.select(F.col("u").alias("q"), "v", F.col("a").alias("aq")), ["q", "v"])
    return closed.groupBy("i", "j").agg(F.sum(F.col("ap") * F.col("aq")).alias("s"))


def tom_distance(edges: DataFrame) -> DataFrame:
    """(i, j, adj, dist) with dist = 1 - (s + a) / (min(k_i, k_j) + 1 - a)."""
    edges = materialise(edges.select("i", "j", "adj"), "adjacency")
    nodes = materialise(strength(edges), "strength")
    k = nodes.select("u", "k")
    top = F.coalesce("s", F.lit(0.0)) + F.col("adj")
    bottom = F.least("ki", "kj") + 1 - F.col("adj")
    return (
        edges.join(shared(edges, nodes), ["i", "j"], "left")
        .join(k.select(F.col("u").alias("i"), F.col("k").alias("ki")), "i")
        .join(k.select(F.col("u").alias("j"), F.col("k").alias("kj")), "j")
        .select("i", "j", "adj", (1 - top / bottom).alias("dist"))
    )
