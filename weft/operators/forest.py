"""Merge forests: independent trees and their dendrograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.components import connected_components
from weft.storage import materialise


def tree_members(forest: DataFrame) -> DataFrame:
    """(tree_id, id) of every id; trees count from 1 in order of their smallest id."""
    links = forest.select(F.col("c1").alias("i"), F.col("merged").alias("j")).unionAll(forest.select("c2", "merged"))
    near = connected_components(links)
    trees = near.select("component").distinct()
    numbered = trees.select("component", F.row_number().over(W.orderBy("component")).cast("long").alias("tree_id"))  # one row a tree
    return materialise(near.join(numbered, "component").select("tree_id", F.col("node").alias("id")), "trees")


def tree_rows(forest: DataFrame, members: DataFrame) -> DataFrame:
    """The forest's rows with their tree_id."""
    return forest.join(members.select(F.col("id").alias("merged"), "tree_id"), "merged").select("tree_id", "merge_no", "c1", "c2", "height", "merged")


def trees(forest: DataFrame) -> DataFrame:
    """(tree_id, ids, rows): sorted ids and merge numbers of each independent tree."""
    members = tree_members(forest)
    ids = members.groupBy("tree_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    rows = tree_rows(forest, members).groupBy("tree_id").agg(F.sort_array(F.collect_set("merge_no")).alias("rows"))
    return ids.join(rows, "tree_id")


def relabelled(members: DataFrame, singletons: int) -> DataFrame:
    """(tree_id, id, label, leaf): ids of a tree numbered from 1 without gaps, leaves first."""
    label = F.dense_rank().over(W.partitionBy("tree_id").orderBy("id"))
    return members.select("tree_id", "id", label.cast("long").alias("label"), (F.col("id") <= singletons).alias("leaf"))


def dendrogram(forest: DataFrame, members: DataFrame, singletons: int) -> DataFrame:
    """(tree_id, step, left, right, height): leaves as negative numbers, earlier merges as positive ones."""
    labels = relabelled(members, singletons)
    cut = labels.groupBy("tree_id").agg(F.sum(F.col("leaf").cast("long")).alias("leaves"))
    named = labels.join(cut, "tree_id").select("id", F.when(F.col("leaf"), -F.col("label")).otherwise(F.col("label") - F.col("leaves")).alias("code"))
    rows = tree_rows(forest, members)
    r = lambda a, b: named.select(F.col("id").alias(a), F.col("code").alias(b))
    return rows.join(r("c1", "left"), "c1").join(r("c2", "right"), "c2").join(r("merged", "step"), "merged").select("tree_id", "step", "left", "right", "height")


def leaf_positions(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Leaves (from 1) from left to right; the last merge is the root."""
    order, stack = [], [len(left)]
    while stack:
        x = stack.pop()
        if x < 0:
            order.append(-x)
        else:
            stack += [int(right[x - 1]), int(left[x - 1])]
    return order


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("step")
    order = leaf_positions(pdf["left"].to_numpy(), pdf["right"].to_numpy())
    return pd.DataFrame({"tree_id": pdf["tree_id"].iloc[0], "pos": range(1, len(order) + 1), "label": order})


def leaf_order(forest: DataFrame, members: DataFrame, singletons: int) -> DataFrame:
    """(tree_id, pos, feature_id): leaves of each dendrogram from left to right."""
    order = dendrogram(forest, members, singletons).groupBy("tree_id").applyInPandas(_order, "tree_id long, pos long, label long")
    return order.join(relabelled(members, singletons).where("leaf"), ["tree_id", "label"]).select("tree_id", "pos", F.col("id").alias("feature_id"))


def segments(forest: DataFrame, members: DataFrame, singletons: int) -> DataFrame:
    """(tree_id, step, x0, x1, y0, y1, y): plot data, one bracket a merge."""
    return dendrogram(forest, members, singletons).groupBy("tree_id").applyInPandas(_segments, "tree_id long, step long, x0 double, x1 double, y0 double, y1 double, y double")


def _segments(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("step")
    left, right, height = (pdf[c].to_numpy() for c in ("left", "right", "height"))
    at = {-leaf: (float(k), 0.0) for k, leaf in enumerate(leaf_positions(left, right), 1)}
    out = []
    for k in range(len(left)):
        (x0, y0), (x1, y1) = at[int(left[k])], at[int(right[k])]
        at[k + 1] = ((x0 + x1) / 2, float(height[k]))
        out.append((k + 1, x0, x1, y0, y1, height[k]))
    return pd.DataFrame(out, columns=["step", "x0", "x1", "y0", "y1", "y"]).assign(tree_id=pdf["tree_id"].iloc[0])
