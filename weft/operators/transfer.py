"""Applying a fitted model to new samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.eigengenes import principal_components
from weft.operators.scaling import scale
from weft.sources.matrix import same_names


def project(long: DataFrame, rotation: DataFrame) -> DataFrame:
    """(sample_id, module, pc, value): sums of value times loading; features outside a module are absent, not zero."""
    return (
        long.join(rotation.select("feature_id", "module", "pc", "loading"), "feature_id")
        .groupBy("sample_id", "module", "pc").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))
    )


def transfer(model, long: DataFrame, feature_dim: DataFrame, scaled: bool = False, only_module_membership: bool = False) -> DataFrame:
    """(sample_id, module, pc, value) of new samples.

    Features are matched by name and must be those of the model. scaled: by
    the new data's own mean and sd first. only_module_membership: components
    are computed anew from the modules, as many of each as the model has.
    """
    if long.isEmpty():
        raise ValueError("the new data have no samples")
    if feature_dim.count() != model.feature_dim.count():
        raise ValueError("the new data have another number of features than the model")
    if not same_names(feature_dim, model.feature_dim):
        raise ValueError("the new data have other features than the model")
    renamed = feature_dim.join(model.feature_dim.select("name", F.col("feature_id").alias("own")), "name").select("feature_id", "own")
    matched = long.join(renamed, "feature_id").select("sample_id", F.col("own").alias("feature_id"), "value")
    if scaled:
        matched = scale(matched)
    if not only_module_membership:
        return project(matched, model.rotation)
    wanted = model.scores.select("module", "pc").distinct()
    most = wanted.agg(F.max("pc")).first()[0]
    found = principal_components(model.modules.select("tree_id", "feature_id", "module"), matched, n_pc=int(most), min_var_explained=1.0)
    return found.scores.join(wanted, ["module", "pc"], "left_semi").select("sample_id", "module", "pc", "value")
