"""The whole pipeline: scale, filter, distance, cluster, cut, aggregate, and a model to transfer."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.linkage import RULES
from weft.operators.boosting import edge_filter
from weft.operators.correlation import METHODS, adjacency, pair_moments, pick_soft_power
from weft.operators.eigengenes import Components, principal_components
from weft.operators.forest import tree_members
from weft.operators.modules import cut_trees, merge_close
from weft.operators.products import feature_stats
from weft.operators.scaling import scale as scaled_matrix
from weft.operators.summary import numbering, renumbered, statistics
from weft.operators.tom import tom_distance
from weft.operators.transfer import transfer
from weft.operators.upgma import upgma, upgma_reciprocal, upgma_rounds
from weft.sources.matrix import sample_features, subset, validate
from weft.storage import materialise

CLUSTERERS = ("components", "rounds", "reciprocal")


@dataclass(frozen=True)
class Params:
    """As the pipeline's steps take them; soft_power None picks one for scale-free topology."""

    stepno: int = 20
    until: int = 0
    soft_power: float | None = None
    method: str = "pearson"
    max_singleton: int | None = None
    min_cluster_size: int = 2
    me_diss_thres: float = 0.25
    n_pc: int = 1
    min_var_explained: float = 0.5
    scale: bool = True
    clusterer: str = "components"
    edges_in_memory: int = 10_000_000
    rule: str = "arithmetic"
    relaxed: bool = False
    seed: int = 1

    def __post_init__(self) -> None:
        for name in ("stepno", "min_cluster_size", "n_pc", "edges_in_memory"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be an integer above 0")
        if not isinstance(self.until, int) or self.until < 0:
            raise ValueError("until must be an integer, 0 or above")
        if not isinstance(self.me_diss_thres, (int, float)):
            raise ValueError("me_diss_thres must be a number")
        if self.soft_power is not None and self.soft_power < 0:
            raise ValueError("soft_power must be 0 or above")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.clusterer not in CLUSTERERS:
            raise ValueError(f"clusterer must be one of {CLUSTERERS}")
        if self.rule not in RULES or (self.rule != "arithmetic" and self.clusterer != "components"):
            raise ValueError(f"rule must be one of {RULES}; rounds and reciprocal pairs know arithmetic alone")
        if self.relaxed and self.clusterer != "rounds":
            raise ValueError("relaxed is a way of the rounds")


@dataclass(frozen=True)
class Model:
    """What a fit leaves; every field is a DataFrame.

    feature_dim (feature_id, name), edges (i, j, adj, dist), forest (c1, c2,
    height, merged, merge_no), trees (tree_id, id), modules (tree_id,
    feature_id, module), scores (sample_id, module, pc, value), rotation
    (feature_id, module, pc, loading), var_explained (module, pc, share).
    Modules above 0 are modules, others background.
    """

    feature_dim: DataFrame
    edges: DataFrame
    forest: DataFrame
    trees: DataFrame
    modules: DataFrame
    scores: DataFrame
    rotation: DataFrame
    var_explained: DataFrame

    def statistics(self) -> DataFrame:
        return statistics(self.modules)

    def transfer(self, long: DataFrame, feature_dim: DataFrame, **options) -> DataFrame:
        return transfer(self, long, feature_dim, **options)

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(**{f.name: spark.read.parquet(f"{path.rstrip('/')}/{f.name}") for f in fields(cls)})


def distances(long: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """(i, j, adj, dist) of a scaled matrix: filter, adjacency and distance in one lazy plan but for what is written."""
    edges = materialise(edge_filter(long, params.stepno, params.until), "filter")
    power = params.soft_power
    if power is None:
        some = sample_features(long.select("feature_id").distinct(), seed=params.seed)
        power = pick_soft_power(materialise(pair_moments(subset(long, some)).select("i", "j", "corr"), "corr"))
    return tom_distance(adjacency(edges, long, power, params.method))


def cluster(edges: DataFrame, params: Params, singletons: int) -> DataFrame:
    if params.clusterer == "rounds":
        return upgma_rounds(edges, 1.0, singletons, params.edges_in_memory, relaxed=params.relaxed)
    if params.clusterer == "reciprocal":
        return upgma_reciprocal(edges, 1.0, singletons)
    return upgma(edges, 1.0, singletons, params.rule)


def aggregate(forest: DataFrame, long: DataFrame, params: Params, singletons: int) -> tuple[DataFrame, DataFrame, Components]:
    """(trees, modules by tree, their components) of a forest."""
    members = tree_members(forest)
    cut = materialise(cut_trees(forest, members, singletons, params.min_cluster_size), "modules")
    stats = feature_stats(long)
    merged = merge_close(cut, long, params.me_diss_thres, stats=stats)
    return members, merged, principal_components(merged, long, params.n_pc, params.min_var_explained, stats=stats)


def fit(long: DataFrame, feature_dim: DataFrame, params: Params = Params()) -> Model:  # noqa: B008
    """Fit a long matrix (sample_id, feature_id, value); see Params and Model."""
    validate(long)
    matrix = materialise(scaled_matrix(long) if params.scale else long.select("sample_id", "feature_id", "value"), "matrix")
    if not matrix.where("value is null").isEmpty():
        raise ValueError("a feature is constant or has missing values")
    singletons = params.max_singleton or int(feature_dim.agg(F.max("feature_id")).first()[0])
    edges = materialise(distances(matrix, params), "edges")
    forest = materialise(cluster(edges, params, singletons), "forest")
    members, modules, parts = aggregate(forest, matrix, params, singletons)
    numbers = materialise(numbering(modules), "numbers")
    final = lambda df, name: materialise(renumbered(df, numbers), name)
    return Model(
        feature_dim, edges, forest, members, final(modules, "modules"), final(parts.scores, "scores").drop("tree_id"),
        final(parts.rotation, "rotation").drop("tree_id"), final(parts.var_explained, "shares").drop("tree_id"),
    )
