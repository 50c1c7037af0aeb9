"""Numbering modules over all trees, and statistics of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbering(modules: DataFrame) -> DataFrame:
    """(tree_id, module, number): modules count from 1 over the trees in order of first appearance.

    A tree's background (0) gets -1, -2, ... in order of the trees, unless it
    is all that the tree has; then it counts as a module. One row a module,
    so the window is over a small table.
    """
    first = modules.groupBy("tree_id", "module").agg(F.min("feature_id").alias("first"))
    kinds = first.groupBy("tree_id").agg(F.count("*").alias("kinds"))
    tagged = first.join(kinds, "tree_id").withColumn("back", (F.col("module") == 0) & (F.col("kinds") > 1))
    rank = F.row_number().over(W.partitionBy("back").orderBy("tree_id", "first")).cast("long")
    return tagged.select("tree_id", "module", F.when(F.col("back"), -rank).otherwise(rank).alias("number"))


def renumbered(table: DataFrame, numbers: DataFrame) -> DataFrame:
    """A table by (tree_id, module) with the overall number as its module, in long form; trees joined end to end."""
    rest = [c for c in table.columns if c not in ("tree_id", "module")]
    return table.join(numbers, ["tree_id", "module"]).select("tree_id", F.col("number").alias("module"), *rest)


def label(module: Column | str, pc: Column | str) -> Column:
    """ME<k>_pc<p>, or ME0_<b>_pc<p> for background b."""
    m = F.col(module) if isinstance(module, str) else module
    return F.when(m > 0, F.format_string("ME%d_pc%d", m, pc)).otherwise(F.format_string("ME0_%d_pc%d", -m, pc))


def parsed(name: Column | str) -> tuple[Column, Column]:
    """(module, pc) of such a label."""
    s = F.col(name) if isinstance(name, str) else name
    back = F.regexp_extract(s, r"^ME0_(\d+)_pc", 1)
    module = F.when(back != "", -back.try_cast("long")).otherwise(F.regexp_extract(s, r"^ME(\d+)_pc", 1).try_cast("long"))
    return module, F.regexp_extract(s, r"_pc(\d+)$", 1).try_cast("int")


def module_sizes(modules: DataFrame) -> DataFrame:
    return modules.groupBy("module").agg(F.count("*").alias("size"))


def statistics(modules: DataFrame) -> DataFrame:
    """One row: modules, background modules, mean size of modules, features unassigned and their share in percent."""
    sizes = module_sizes(modules)
    real = F.col("module") > 0
    total, back = F.sum("size"), F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0))
    return sizes.agg(
        F.count(F.when(real, 1)).alias("n_modules"),
        F.count(F.when(~real, 1)).alias("n_background"),
        F.avg(F.when(real, F.col("size"))).alias("mean_size"),
        back.cast("long").alias("n_unassigned"),
        (back * 100.0 / total).alias("pct_unassigned"),
    )


def dense_rotation(rotation: DataFrame, feature_dim: DataFrame) -> DataFrame:
    """(feature_id, module, pc, loading) with zeros where a feature is outside a module; on demand only."""
    columns = rotation.select("module", "pc").distinct()
    full = feature_dim.select("feature_id").join(F.broadcast(columns.agg(F.collect_list(F.struct("module", "pc")).alias("cols"))), how="cross")
    cells = full.select("feature_id", F.explode("cols").alias("c")).select("feature_id", "c.module", "c.pc")
    return cells.join(rotation, ["feature_id", "module", "pc"], "left").select("feature_id", "module", "pc", F.coalesce("loading", F.lit(0.0)).alias("loading"))


def colour_ranks(modules: DataFrame) -> DataFrame:
    """(module, rank): modules dealt so that neighbours in number lie far apart; for plots."""
    n = F.count("*").over(W.partitionBy())
    k = F.row_number().over(W.orderBy("module")) - 1
    half = F.ceil(n / 2)
    real = modules.where("module > 0").select("module").distinct()
    return real.select("module", F.when(k < half, k * 2).otherwise((k - half) * 2 + 1).cast("int").alias("rank"))
