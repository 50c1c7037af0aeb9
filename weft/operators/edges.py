"""Edges between rounds of clustering: climb to current roots, split, collate, thicken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.storage import discard, materialise


def root_map(forest: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) of every id in a merge forest, by pointer doubling: rounds grow with the log of its depth."""
    up = forest.select(F.col("c1").alias("id"), F.col("merged").alias("root")).unionAll(forest.select("c2", "merged"))
    tops = forest.select(F.col("merged").alias("id"), F.col("merged").alias("root")).join(up.select("id"), "id", "left_anti")
    now = materialise(up.unionAll(tops), "roots")
    for _ in range(max_rounds):
        hop = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(hop, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        discard(now)
        path = after._weft_path
        now = after.select("id", "root")
        now._weft_path = path
        if after.where("moved").isEmpty():
            return now
    raise RuntimeError("the merge table has a cycle")


def cluster_sizes(roots: DataFrame, singletons: int) -> DataFrame:
    """(id, size): leaves under each root."""
    return roots.where(F.col("id") <= singletons).groupBy(F.col("root").alias("id")).agg(F.count("*").alias("size"))


def all_sizes(forest: DataFrame, singletons: int) -> DataFrame:
    """(id, size) of every merged cluster, at any level: leaves climb one level a round."""
    up = materialise(forest.select(F.col("c1").alias("child"), F.col("merged").alias("id")).unionAll(forest.select("c2", "merged")), "parents")
    level = materialise(up.where(F.col("child") <= singletons).groupBy("id").agg(F.count("*").alias("n")), "level")
    total = level
    while not level.isEmpty():
        level = materialise(level.select(F.col("id").alias("child"), "n").join(up, "child").groupBy("id").agg(F.sum("n").alias("n")), "level")
        total = total.unionAll(level)
    return total.groupBy("id").agg(F.sum("n").cast("long").alias("size"))


def remap(edges: DataFrame, roots: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(i, j, dist, w, changed): ends replaced by their current roots, edges inside a cluster dropped.

    w is the product of the old ends' sizes (1 for singletons). The tables of
    roots and sizes hold merged ids only; Spark broadcasts them while they
    are small and shuffles beyond.
    """
    r = lambda a, b: roots.select(F.col("id").alias(a), F.col("root").alias(b))
    out = edges.select("i", "j", "dist").join(r("i", "ri"), "i", "left").join(r("j", "rj"), "j", "left")
    if sizes is not None:
        s = lambda a, b: sizes.select(F.col("id").alias(a), F.col("size").alias(b))
        out = out.join(s("i", "si"), "i", "left").join(s("j", "sj"), "j", "left")
    else:
        out = out.withColumns({"si": F.lit(None).cast("long"), "sj": F.lit(None).cast("long")})
    a, b = F.coalesce("ri", "i"), F.coalesce("rj", "j")
    w = F.coalesce("si", F.lit(1).cast("long")) * F.coalesce("sj", F.lit(1).cast("long"))
    changed = (a != F.col("i")) | (b != F.col("j"))
    return out.select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), "dist", w.cast("long").alias("w"), changed.alias("changed")).where("i <> j")


def collate(weighted: DataFrame) -> DataFrame:
    """(i, j, sum_d, w): sums of distance times weight and of weights."""
    return weighted.groupBy("i", "j").agg(F.sum(F.col("dist") * F.col("w")).alias("sum_d"), F.sum("w").cast("long").alias("w"))


def thicken(collated: DataFrame, sizes: DataFrame, psi: float) -> DataFrame:
    """(i, j, dist): the mean over all pairs of members, absent ones at psi; sizes in 64 bits."""
    s = lambda a, b: sizes.select(F.col("id").alias(a), F.col("size").alias(b))
    out = collated.join(s("i", "si"), "i", "left").join(s("j", "sj"), "j", "left")
    pairs = (F.coalesce("si", F.lit(1)) * F.coalesce("sj", F.lit(1))).cast("double")
    return out.select("i", "j", (((pairs - F.col("w")) * psi + F.col("sum_d")) / pairs).alias("dist"))


def top_edges(edges: DataFrame, m: int, in_order: bool = False) -> DataFrame:
    """The m smallest edges, by (dist, i, j); the first m of edges that are in order already."""
    return (edges if in_order else edges.orderBy("dist", "i", "j")).limit(m)
