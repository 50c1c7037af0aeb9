"""Modules of trees: dynamic cut, and merging modules with close eigengenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.eigengenes import TASK_CELLS, principal_components
from weft.operators.forest import dendrogram, leaf_positions, relabelled
from weft.operators.products import MOST_FEATURES, feature_stats, products, sample_rows
from weft.storage import materialise

#: Merges above this height never join a module.
CUT = 0.99


def gaps(left: np.ndarray, right: np.ndarray, height: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Leaves in order, and the height at which each adjacent pair of them meets."""
    order = leaf_positions(left, right)
    between = np.zeros(max(0, len(order) - 1))
    span: dict[int, tuple[int, int]] = {-leaf: (k, k) for k, leaf in enumerate(order)}
    for k in range(len(left)):
        a, b = span[int(left[k])], span[int(right[k])]
        between[b[0] - 1] = height[k]  # the left part ends where the right one begins
        span[k + 1] = (a[0], b[1])
    return order, between


def _runs(h: np.ndarray, level: float, least: int) -> list[int]:
    """Where to cut a cluster of joining heights h: above the level, followed by a run below it that is long enough."""
    below = h < level
    cuts = []
    for k in np.flatnonzero(~below):
        n = 0
        while k + 1 + n < len(h) and below[k + 1 + n]:
            n += 1
        if n + 1 >= least and (not cuts or k - cuts[-1] >= least or n):
            cuts.append(int(k))
    return cuts


def _pieces(lo: int, hi: int, between: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Leaf ranges [lo, hi) of a branch after recursive cuts at the mean, upper-middle and lower-middle level."""
    h = between[lo : hi - 1]
    if hi - lo < 2 * least or not len(h) or h.max() == h.min():
        return [(lo, hi)]
    mean = h.mean()
    for level in (mean, (mean + h.max()) / 2, (mean + h.min()) / 2):
        edges = [lo, *(lo + k + 1 for k in _runs(h, level, least)), hi]
        parts = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        if sum(b - a >= least for a, b in parts) > 1:
            return [p for a, b in parts for p in _pieces(a, b, between, least)]
    return [(lo, hi)]


def dynamic_cut(left: np.ndarray, right: np.ndarray, height: np.ndarray, least: int = 2, cut: float = CUT) -> dict[int, int]:
    """Module of each leaf: 0 unassigned, else by decreasing size."""
    order, between = gaps(left, right, height)
    edges = [0, *(int(k) + 1 for k in np.flatnonzero(between > cut)), len(order)]
    found = [p for a, b in zip(edges, edges[1:], strict=False) if b - a >= least for p in _pieces(a, b, between, least)]
    found = [p for p in found if p[1] - p[0] >= least]
    found.sort(key=lambda p: (p[0] - p[1], p[0]))
    out = dict.fromkeys(order, 0)
    for module, (a, b) in enumerate(found, 1):
        out.update(dict.fromkeys(order[a:b], module))
    return out


def _cut(least: int, cut: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        got = dynamic_cut(pdf["left"].to_numpy(), pdf["right"].to_numpy(), pdf["height"].to_numpy(), least, cut)
        return pd.DataFrame({"tree_id": pdf["tree_id"].iloc[0], "label": list(got), "module": list(got.values())})

    return run


def cut_trees(forest: DataFrame, members: DataFrame, singletons: int, min_cluster_size: int = 2, cut: float = CUT) -> DataFrame:
    """(tree_id, feature_id, module) of all leaves; one grouped task a tree, over its merges alone."""
    if not isinstance(min_cluster_size, int) or min_cluster_size < 1:
        raise ValueError("min_cluster_size must be an integer above 0")
    got = dendrogram(forest, members, singletons).groupBy("tree_id").applyInPandas(_cut(min_cluster_size, cut), "tree_id long, label long, module long")
    return got.join(relabelled(members, singletons).where("leaf"), ["tree_id", "label"]).select("tree_id", F.col("id").alias("feature_id"), "module")


def average_linkage_groups(diss: np.ndarray, cut: float) -> np.ndarray:
    """Group of each row: average linkage, merging while the least distance is at most cut."""
    n = len(diss)
    d, size, group = diss.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    while n > 1:
        a, b = np.unravel_index(d.argmin(), d.shape)
        if not d[a, b] <= cut:
            break
        a, b = min(a, b), max(a, b)
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        size[a] += size[b]
        group[group == b] = a
    return group


def _close(cut: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="sample_id", columns="module", values="value").sort_index(axis=1)
        names = wide.columns.to_numpy()
        group = average_linkage_groups(1 - np.corrcoef(wide.to_numpy().T), cut) if len(names) > 1 else np.zeros(1, int)
        return pd.DataFrame({"tree_id": pdf["tree_id"].iloc[0], "module": names, "merged": names[group]})

    return run


def _changes(mes: DataFrame, threshold: float, task_cells: int) -> DataFrame:
    """(tree_id, module, merged) of eigengenes; a tree of more than task_cells scores by their products, others in a task each."""
    spark = mes.sparkSession
    sizes = mes.groupBy("tree_id").agg(F.count("*").alias("cells"), F.countDistinct("module").alias("p"))
    large = sizes.where((F.col("cells") > task_cells) & (F.col("p") <= MOST_FEATURES)).select("tree_id").collect()
    got = []
    for tree in (r.tree_id for r in large):
        own = mes.where(F.col("tree_id") == tree).select("sample_id", F.col("module").alias("feature_id"), "value")
        found = products(sample_rows(own), feature_stats(own))
        group = average_linkage_groups(1 - found.correlations(), threshold)
        got += [(tree, int(m), int(found.ids[g])) for m, g in zip(found.ids, group, strict=True)]
    kinds = "tree_id long, module long, merged long"
    rest = mes.join(F.broadcast(spark.createDataFrame([(r.tree_id,) for r in large], "tree_id long")), "tree_id", "left_anti") if large else mes
    small = rest.groupBy("tree_id").applyInPandas(_close(threshold), kinds)
    return small.unionByName(spark.createDataFrame(got, kinds)) if large else small


def merge_close(modules: DataFrame, long: DataFrame, threshold: float = 0.25, rounds: int = 100, stats: DataFrame | None = None, task_cells: int = TASK_CELLS) -> DataFrame:
    """Modules whose eigengenes are within ``threshold`` of one another (1 - correlation, average linkage) merged.

    Repeated until nothing merges; a merged module has its smallest label;
    0 never merges. Each round computes eigengenes of all trees at once.
    ``stats`` and ``task_cells`` as of ``principal_components``.
    """
    stats = feature_stats(long) if stats is None else stats
    now = materialise(modules, "modules")
    for _ in range(rounds):
        real = now.where("module <> 0")
        many = real.select("tree_id", "module").distinct().groupBy("tree_id").count().where("count > 1")
        if many.isEmpty():
            break
        mes = principal_components(real.join(many.select("tree_id"), "tree_id", "left_semi"), long, n_pc=1, aligned=True, stats=stats, task_cells=task_cells).scores
        change = materialise(_changes(mes, threshold, task_cells), "change")
        if change.where("module <> merged").isEmpty():
            break
        now = materialise(now.join(change, ["tree_id", "module"], "left").select("tree_id", "feature_id", F.coalesce("merged", "module").alias("module")), "modules")
    return now
