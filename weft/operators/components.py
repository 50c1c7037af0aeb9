"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft.storage import discard, materialise


def connected_components(edges: DataFrame, a: str = "i", b: str = "j", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable from each node.

    Min-label propagation with pointer jumping: every round each node takes
    the smallest label among its neighbours and then the label of its label,
    so long chains shrink geometrically. State is a written table per round
    (never the driver, never executor-local); the only number that reaches
    the driver is how many labels changed. Nodes without an edge don't
    appear. Self edges and nulls are ignored; an empty table gives an empty
    result.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialise(ends.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("now")
        )
        roots = labels.select(F.col("node").alias("now"), F.col("component").alias("jump"))
        seen = Observation()
        jumped = stepped.join(roots, "now", "left").select("node", "before", F.least("now", F.coalesce("jump", "now")).alias("component"))
        after = materialise(jumped.observe(seen, F.count(F.when(F.col("component") != F.col("before"), 1)).alias("changed")), "labels")
        discard(labels)
        labels = after.select("node", "component")
        labels._weft_path = after._weft_path
        if not seen.get.get("changed"):
            break
    else:
        raise RuntimeError("connected components did not settle")
    discard(both)
    return labels
