"""The library's own queries over the test tables, and the same in DuckDB SQL.

Matrices: E is ``embeddings`` with positions as features and vectors as
samples; L the numeric columns of ``lineitem``; H the hourly counts of
``events`` by type. Small fixtures (edges, a merge forest) are constants in
both forms. Doubles are rounded to 6 decimals, plus 0.0 against minus zero.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.linkage import RULES, linkage
from weft.operators import boosting, correlation, edges, eigengenes, forest, modules, scaling, summary, tom, transfer, upgma
from weft.operators.components import connected_components
from weft.plans import pipeline
from weft.sources import edges as edge_io
from weft.sources import matrix
from weft.storage import materialise, new_path

STEPS, POWER = 20, 3.0
#: A sparse graph of two components with known average linkage, missing pairs at 100.
GRAPH = [
    (1, 2, 1e-100), (1, 3, 1e-40), (1, 4, 2e-40), (2, 3, 1e-80), (2, 4, 1e-50), (3, 4, 4e-10), (11, 12, 10.0), (11, 13, 11.0),
    (12, 13, 12.0), (12, 14, 20.0), (13, 14, 30.0), (21, 22, 50.0), (22, 23, 70.0), (1, 23, 90.0),
]
PSI, SINGLETONS = 100.0, 23
MERGES = [(1, 2, 1e-100, 24), (3, 24, 5e-41, 25), (4, 25, 4e-10 / 3, 26), (11, 12, 10.0, 27), (13, 27, 11.5, 28), (21, 22, 50.0, 29), (14, 28, 50.0, 30), (23, 29, 85.0, 31), (26, 31, 1190 / 12, 32)]
LINES = ["1 2 20.0", "2 1 20.0", "3 3 30.1", "1 3 1e-20", "1 4 1e+02", "03 1 1.0", "00 11 10", "x 1 2"]
#: Rounds in which the fixture's merges are made with 5 edges in memory.
ROUNDS = [1, 1, 2, 2, 2, 3, 3, 3, 3]


def r6(c: Column | str, name: str) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.from_arrays(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def e_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    df = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    return df, df.agg(F.max(F.size("embedding"))).first()[0] or 1


L_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def l_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").withColumn("sample", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return matrix.from_wide(df, "sample", L_COLUMNS)[0]


def h_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are event types in alphabetical order, samples the hours that have events."""
    df = _table(spark, sf_dir, "events").select(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("h"), "event_type")
    counts = df.groupBy("h").pivot("event_type", sorted(r[0] for r in df.select("event_type").distinct().collect())).count().na.fill(0)
    names = counts.columns[1:]
    return matrix.from_wide(counts.select("h", *[F.col(c).cast("double").alias(c) for c in names]), "h", names)[0]


def graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRAPH, "i long, j long, dist double")


def merges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*m, k) for k, m in enumerate(MERGES, 1)], upgma.FOREST)


def part_merges(spark: SparkSession) -> DataFrame:
    """The first six merges: a forest under construction."""
    return merges(spark).where("merge_no <= 6")


def e_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    long = scaling.scale(e_matrix(spark, sf_dir))
    return boosting.edge_filter(long, STEPS), long


def e_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, long = e_edges(spark, sf_dir)
    return correlation.adjacency(materialise(found, "filter"), long, POWER)


def _corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.gram_blocks(*_vec(spark, sf_dir)).where("i < j")


def _vec(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, int]:
    df, p = e_vectors(spark, sf_dir)
    return df, "embedding", p


def _all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = e_matrix(spark, sf_dir).select("feature_id").distinct()
    return ids.select(F.col("feature_id").alias("i")).join(ids.select(F.col("feature_id").alias("j")), F.col("i") < F.col("j"))


def _pair_modules(long: DataFrame) -> DataFrame:
    """Features (1, 2), (3, 4), ... as modules of one tree."""
    ids = long.select("feature_id").distinct()
    return ids.select(F.lit(1).cast("long").alias("tree_id"), "feature_id", F.expr("(feature_id + 1) div 2").alias("module"))


def _eights(long: DataFrame) -> DataFrame:
    ids = long.select("feature_id").distinct()
    return ids.select(F.lit(1).cast("long").alias("tree_id"), "feature_id", F.expr("(feature_id - 1) div 8 + 1").alias("module"))


def _label_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as features, their label as module, five trees."""
    df = _table(spark, sf_dir, "embeddings").where("label is not null")
    return df.select((F.col("vec_id") % 5 + 1).alias("tree_id"), F.col("vec_id").alias("feature_id"), F.col("label").cast("long").alias("module"))


# Queries.


def q_scale(spark, sf_dir):
    return scaling.scale(e_matrix(spark, sf_dir)).select("sample_id", "feature_id", r6("value", "value"))


def q_center(spark, sf_dir):
    return scaling.center(e_matrix(spark, sf_dir)).select("sample_id", "feature_id", r6("value", "value"))


def q_scale_lineitem(spark, sf_dir):
    return scaling.scale(l_matrix(spark, sf_dir)).select("sample_id", "feature_id", r6("value", "value"))


def q_vectors(spark, sf_dir):
    v = matrix.to_vectors(e_matrix(spark, sf_dir))
    return v.select("feature_id", F.size("vec").cast("long").alias("n"), r6(F.get("vec", F.lit(0)), "first"), r6(F.element_at("vec", -1), "last"))


def q_feature_subset(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    wanted = long.groupBy("feature_id").agg(F.avg("value").alias("m")).where("m > 0")
    return matrix.subset(long, wanted).groupBy("feature_id").agg(F.count("*").alias("n"))


def q_gram(spark, sf_dir):
    return correlation.gram_blocks(*_vec(spark, sf_dir)).select("i", "j", r6("gram", "gram"))


def q_cov(spark, sf_dir):
    return correlation.gram_blocks(*_vec(spark, sf_dir)).select("i", "j", r6("cov", "cov"))


def q_corr_pairs(spark, sf_dir):
    return _corr(spark, sf_dir).select("i", "j", r6("corr", "corr"))


def q_corr_lineitem(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(F.array(*L_COLUMNS).alias("vec"))
    return correlation.gram_blocks(df, "vec", 4).where("i < j").select("i", "j", r6("corr", "corr"))


def q_corr_events(spark, sf_dir):
    return correlation.pair_moments(h_matrix(spark, sf_dir)).select("i", "j", r6("cov", "cov"), r6("corr", "corr"))


def q_spearman(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    return correlation.edge_correlation(_all_pairs(spark, sf_dir), long, "spearman").select("i", "j", r6("corr", "corr"))


def q_kendall(spark, sf_dir):
    return correlation.edge_correlation(correlation.pair_moments(h_matrix(spark, sf_dir)).select("i", "j"), h_matrix(spark, sf_dir), "kendall").select("i", "j", r6("corr", "corr"))


def q_boost_filter(spark, sf_dir):
    return e_edges(spark, sf_dir)[0]


def q_boost_unscaled(spark, sf_dir):
    return boosting.edge_filter(e_matrix(spark, sf_dir), STEPS)


def q_boost_until(spark, sf_dir):
    return boosting.edge_filter(scaling.scale(e_matrix(spark, sf_dir)), STEPS, until=16)


def q_adjacency(spark, sf_dir):
    return e_adjacency(spark, sf_dir).select("i", "j", r6(F.col("adj") * 1000, "adj_milli"))


def q_strength(spark, sf_dir):
    return tom.strength(materialise(e_adjacency(spark, sf_dir), "adj")).select("u", r6("k", "k"), "degree")


def q_common_neighbours(spark, sf_dir):
    adj = materialise(e_adjacency(spark, sf_dir), "adj")
    return tom.shared(adj.withColumn("adj", F.lit(1.0)), tom.strength(adj)).select("i", "j", F.col("s").cast("long").alias("n_common"))


def q_tom_dist(spark, sf_dir):
    return tom.tom_distance(e_adjacency(spark, sf_dir)).select("i", "j", r6("dist", "dist"))


def q_top_m_edges(spark, sf_dir):
    """The 500 strongest correlations as distances; the limit is the operator."""
    dist = _corr(spark, sf_dir).select("i", "j", F.round(1 - F.abs("corr"), 9).alias("dist"))
    return edges.top_edges(dist, 500).select("i", "j", r6("dist", "dist"))


def q_soft_power_table(spark, sf_dir):
    found = correlation.soft_power_table(materialise(_corr(spark, sf_dir).select("i", "j", "corr"), "corr"))
    return found.select(F.col("power").cast("long").alias("power"), r6("r2", "r2"), r6("slope", "slope"), r6("signed_r2", "signed_r2"), r6("mean_k", "mean_k"))


def q_edge_validate(spark, sf_dir):
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(LINES, 1)], "line long, content string")
    return edge_io.check_lines(spark, lines).select("line", "problem")


def q_edge_validate_rows(spark, sf_dir):
    """All rows of lineitem as lines: zero ids, self edges, duplicates and broken numbers among them."""
    number = F.when(F.col("l_quantity") % 7 == 0, F.concat(F.lit("x"), F.col("l_quantity").cast("long"))).otherwise(F.col("l_quantity").cast("long").cast("string"))
    content = F.concat_ws(" ", F.col("l_orderkey") % 90, F.col("l_partkey") % 90, number)
    lines = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), content.alias("content"))
    return edge_io.check_lines(spark, lines).select("line", "problem")


def q_edge_file(spark, sf_dir):
    """Distances written as compressed text, in plain notation, and read back, ends exchanged on the way."""
    dist = tom.tom_distance(e_adjacency(spark, sf_dir))
    path = new_path(spark, "edge-file")
    edge_io.write_edges(dist.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"), path)
    return edge_io.as_intervals(edge_io.read_edges(spark, path)).select("i", "j", r6("lb", "lb"), r6("ub", "ub"))


def q_weighted_file(spark, sf_dir):
    """Weighted edges as sorted text, read back as sums."""
    dist = tom.tom_distance(e_adjacency(spark, sf_dir)).withColumn("w", F.col("i") + F.col("j"))
    path = new_path(spark, "weighted-file")
    edge_io.write_weighted(dist.select("i", "j", (F.col("dist") * F.col("w")).alias("sum_d"), "w"), path, in_order=True)
    return edge_io.read_weighted_edges(spark, path).select("i", "j", r6("sum_d", "sum_d"), "w")


def q_split_file(spark, sf_dir):
    """Adjacencies dealt to four text files; each line comes back once."""
    path = new_path(spark, "split-file")
    edge_io.write_split(e_adjacency(spark, sf_dir).select("i", "j", edge_io.plain(F.round("adj", 9)).alias("adj")), path, 4, text=True)
    return edge_io.read_edges(spark, path).select("i", "j", r6(F.col("dist") * 1000, "adj_milli"))


def q_scientific_edges(spark, sf_dir):
    return edge_io.scientific(graph(spark))


def q_max_singleton(spark, sf_dir):
    n = edge_io.max_singleton(graph(spark))
    return spark.createDataFrame([(n,)], "max_singleton long")


def q_components(spark, sf_dir):
    strong = _corr(spark, sf_dir).where("abs(corr) > 0.12").select("i", "j")
    return connected_components(strong).select("node", "component")


def q_remap_roots(spark, sf_dir):
    return edges.root_map(part_merges(spark)).select("id", "root")


def q_cluster_sizes(spark, sf_dir):
    return edges.all_sizes(merges(spark), SINGLETONS)


def q_existing_vs_changed(spark, sf_dir):
    out = edges.remap(graph(spark), edges.root_map(part_merges(spark)))
    return out.select("i", "j", r6("dist", "dist"), "w", "changed")


def q_collate(spark, sf_dir):
    return edges.collate(edges.remap(graph(spark), edges.root_map(part_merges(spark)))).select("i", "j", r6("sum_d", "sum_d"), "w")


def q_thicken(spark, sf_dir):
    half = part_merges(spark)
    sums = edges.collate(edges.remap(graph(spark), edges.root_map(half)))
    return edges.thicken(sums, edges.all_sizes(half, SINGLETONS), PSI).select("i", "j", r6("dist", "dist"))


def q_weighted_mean(spark, sf_dir):
    w = graph(spark).select("i", "j", (F.col("dist") * F.col("i")).alias("sum_d"), F.col("i").alias("w"))
    return w.select("i", "j", r6(F.col("sum_d") / F.col("w"), "mean"), "w")


def _golden(df: DataFrame) -> DataFrame:
    return df.select("c1", "c2", r6("height", "height"), "merged", "merge_no")


def q_upgma_small(spark, sf_dir):
    return _golden(upgma.upgma(graph(spark), PSI, SINGLETONS))


def e_distances(spark, sf_dir) -> DataFrame:
    return materialise(tom.tom_distance(e_adjacency(spark, sf_dir)), "dist")


def q_upgma_rounds(spark, sf_dir):
    """The forest of q_upgma_matrix with 300 edges in memory at a time."""
    return _golden(upgma.upgma_rounds(e_distances(spark, sf_dir), m=300))


def q_upgma_reciprocal(spark, sf_dir):
    """The forest of q_upgma_matrix by rounds of mutually nearest pairs."""
    return _golden(upgma.upgma_reciprocal(e_distances(spark, sf_dir)))


def q_upgma_rounds_small(spark, sf_dir):
    return _golden(upgma.upgma_rounds(graph(spark), PSI, SINGLETONS, m=5))


def q_upgma_reciprocal_small(spark, sf_dir):
    return _golden(upgma.upgma_reciprocal(graph(spark), PSI, SINGLETONS))


def q_forest_file(spark, sf_dir):
    """A forest's merges appended to one text file in two parts, and read back with its checks."""
    found, n = e_forest(spark, sf_dir)
    path = new_path(spark, "forest-file")
    for part in ("merge_no <= 20", "merge_no > 20"):
        edge_io.write_forest(found.where(part), path)
    return edge_io.read_forest(spark, path).select("c1", "c2", r6("height", "height"), "merged")


def q_sizes_file(spark, sf_dir):
    """Sizes of all clusters of the forest, written and read back."""
    found, n = e_forest(spark, sf_dir)
    path = new_path(spark, "sizes-file")
    edge_io.write_sizes(edges.all_sizes(found, n), path)
    return edge_io.read_sizes(spark, path)


def q_forest_roots(spark, sf_dir):
    """The root of every id of the whole forest."""
    return edges.root_map(e_forest(spark, sf_dir)[0].select("c1", "c2", "height", "merged")).select("id", "root")


def q_forest_dendrogram(spark, sf_dir):
    found, n = e_forest(spark, sf_dir)
    d = forest.dendrogram(found, forest.tree_members(found), n)
    return d.select("tree_id", "step", "left", "right", r6("height", "height"))


def q_fit(spark, sf_dir):
    """The whole fit of the embeddings' positions: the module of every feature."""
    long = e_matrix(spark, sf_dir)
    dim = long.select("feature_id").distinct().select("feature_id", F.concat(F.lit("f"), "feature_id").alias("name"))
    model = pipeline.fit(long, dim, pipeline.Params(stepno=STEPS, soft_power=POWER))
    return model.modules.select("tree_id", "feature_id", "module")


def e_forest(spark, sf_dir) -> tuple[DataFrame, int]:
    dist = e_distances(spark, sf_dir)
    n = edge_io.max_singleton(dist)
    return materialise(upgma.upgma(dist, 1.0, n), "forest"), n


def q_upgma_matrix(spark, sf_dir):
    return e_forest(spark, sf_dir)[0].select("c1", "c2", r6("height", "height"), "merged", "merge_no")


def q_trees(spark, sf_dir):
    t = forest.trees(merges(spark))
    return t.select("tree_id", F.array_join("ids", ",").alias("ids"), F.array_join("rows", ",").alias("rows"))


def q_tree_relabel(spark, sf_dir):
    return forest.relabelled(forest.tree_members(merges(spark)), SINGLETONS)


def q_dendrogram(spark, sf_dir):
    d = forest.dendrogram(merges(spark), forest.tree_members(merges(spark)), SINGLETONS)
    return d.select("tree_id", "step", "left", "right", r6("height", "height"))


def q_leaf_order(spark, sf_dir):
    found, n = e_forest(spark, sf_dir)
    return forest.leaf_order(found, forest.tree_members(found), n)


def q_plot_segments(spark, sf_dir):
    found, n = e_forest(spark, sf_dir)
    s = forest.segments(found, forest.tree_members(found), n)
    return s.select("tree_id", "step", *[r6(c, c) for c in ("x0", "x1", "y0", "y1", "y")])


def q_modules(spark, sf_dir):
    found, n = e_forest(spark, sf_dir)
    return modules.cut_trees(found, forest.tree_members(found), n, 2)


def _report(spark) -> DataFrame:
    return upgma.round_report(upgma.upgma_rounds(graph(spark), PSI, SINGLETONS, m=5, recorded=True))


def q_round_thresholds(spark, sf_dir):
    return _report(spark).select("round", r6("last_height", "height"), F.col("last_merged").alias("merged"))


def q_merge_counts(spark, sf_dir):
    return _report(spark).select("round", F.col("merges").alias("n"), r6("max_height", "max_height"))


def q_round_totals(spark, sf_dir):
    """Of recorded rounds over the embeddings' graph: edges at first, merges in all, the highest merge, whether rounds only shrink."""
    found = upgma.round_report(upgma.upgma_rounds(e_distances(spark, sf_dir), m=300, recorded=True))
    order = F.transform(F.array_sort(F.collect_list(F.struct("round", "n_edges"))), lambda x: x.n_edges)
    return found.agg(F.max("n_edges").alias("n_edges"), F.sum("merges").alias("merges"), r6(F.max("max_height"), "max_height"), (order == F.reverse(F.array_sort(order))).alias("shrinks"))


def q_linkage_rules(spark, sf_dir):
    rows = graph(spark).where("i > 4").select(F.col("i").cast("double").alias("n1"), F.col("j").cast("double").alias("n2"), F.col("dist").alias("v1"), (F.col("dist") + 7).alias("v2"))
    n1, v1, n2, v2 = (F.col(c) for c in ("n1", "v1", "n2", "v2"))
    return rows.select("n1", "n2", *[r6(linkage(rule, n1, v1, n2, v2), rule) for rule in RULES])


def q_module_sizes(spark, sf_dir):
    return summary.module_sizes(_label_modules(spark, sf_dir))


def q_module_numbering(spark, sf_dir):
    return summary.numbering(_label_modules(spark, sf_dir))


def q_summary_stats(spark, sf_dir):
    m = _label_modules(spark, sf_dir)
    s = summary.statistics(summary.renumbered(m, summary.numbering(m)))
    return s.select("n_modules", "n_background", r6("mean_size", "mean_size"), "n_unassigned", r6("pct_unassigned", "pct_unassigned"))


def q_colour_ranks(spark, sf_dir):
    m = _label_modules(spark, sf_dir)
    return summary.colour_ranks(summary.renumbered(m, summary.numbering(m))).select("module", F.col("rank").cast("long").alias("rank"))


def q_me_labels(spark, sf_dir):
    n = summary.numbering(_label_modules(spark, sf_dir)).select("number", summary.label("number", F.lit(2)).alias("label"))
    module, pc = summary.parsed("label")
    return n.select("number", "label", module.alias("module"), pc.alias("pc"))


def q_pc_var_explained(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    found = eigengenes.principal_components(_pair_modules(long), long, n_pc=2, min_var_explained=2.0)
    return found.var_explained.select("module", F.col("pc").cast("long").alias("pc"), r6("share", "share"))


def q_module_validity(spark, sf_dir):
    """Every fifth feature is made constant, so that its pair can't be decomposed."""
    long = e_matrix(spark, sf_dir).withColumn("value", F.when(F.col("feature_id") % 5 == 0, 1.0).otherwise(F.col("value")))
    found = eigengenes.principal_components(_pair_modules(long), long, trap_errors=True)
    return eigengenes.validity(_pair_modules(long), found)


def q_pc_scores(spark, sf_dir):
    """Squared scores of the first component of each pair of features."""
    long = e_matrix(spark, sf_dir)
    found = eigengenes.principal_components(_pair_modules(long), long)
    return found.scores.where("pc = 1").select("module", "sample_id", r6(F.col("value") * F.col("value") * 1000, "square_milli"))


def q_cum_pcs(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    found = eigengenes.principal_components(_pair_modules(long), long, n_pc=2, min_var_explained=2.0)
    return eigengenes.components_needed(found.var_explained, 0.52, 2).select("module", F.col("n_pcs").cast("long").alias("n_pcs"))


def q_avg_expr(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    return eigengenes.average_expression(_eights(long), scaling.scale(long)).select("module", "sample_id", r6("value", "value"))


def q_me_dissim(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    mean = materialise(eigengenes.average_expression(_eights(long), scaling.scale(long)).withColumn("pc", F.lit(1)), "means")
    return eigengenes.dissimilarity(mean).select("a", "b", r6("diss", "diss"))


def q_transfer(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    rotation = _eights(long).select("feature_id", "module", F.lit(1).alias("pc"), ((F.col("feature_id") % 8 + 1) / 10).alias("loading"))
    return transfer.project(long, rotation).select("sample_id", "module", r6("value", "value"))


def q_transfer_by_name(spark, sf_dir):
    """New samples whose features are numbered the other way round: matched by name, scaled, projected."""
    long = e_matrix(spark, sf_dir)
    ids = materialise(long.select("feature_id").distinct(), "ids")
    top = ids.agg(F.max("feature_id")).first()[0] or 0
    rotation = _eights(long).select("feature_id", "module", F.lit(1).alias("pc"), ((F.col("feature_id") % 8 + 1) / 10).alias("loading"))
    name = F.concat(F.lit("f"), "feature_id").alias("name")
    model = SimpleNamespace(feature_dim=ids.select("feature_id", name), rotation=rotation)
    turned = (F.lit(top + 1) - F.col("feature_id")).alias("feature_id")
    found = transfer.transfer(model, long.select("sample_id", turned, "value"), ids.select(turned, name), scaled=True)
    return found.select("sample_id", "module", r6("value", "value"))


def q_dense_rotation(spark, sf_dir):
    long = e_matrix(spark, sf_dir)
    rotation = _eights(long).select("feature_id", "module", F.lit(1).alias("pc"), (F.col("feature_id") / 10).alias("loading"))
    return summary.dense_rotation(rotation, long.select("feature_id").distinct()).select("feature_id", "module", r6("loading", "loading"))


def q_name_set_check(spark, sf_dir):
    a, b = (_table(spark, sf_dir, t) for t in ("region", "nation"))
    dim = lambda df, c: df.select(F.col(c).cast("string").alias("name"))
    return spark.createDataFrame([(matrix.same_names(dim(a, "r_regionkey"), dim(a, "r_regionkey")), matrix.same_names(dim(a, "r_regionkey"), dim(b, "n_regionkey")))], "same boolean, other boolean")


def q_anti_ids(spark, sf_dir):
    members = forest.tree_members(merges(spark))
    return spark.range(1, SINGLETONS + 1).join(members, "id", "left_anti").select("id")


def q_transposed(spark, sf_dir):
    return matrix.transposed(e_matrix(spark, sf_dir)).groupBy("feature_id").agg(r6(F.sum("value"), "total"))


# SQL.

E = "e AS (SELECT vec_id AS sample_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS feature_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
Z = E + ", m AS (SELECT feature_id, avg(value) AS mean, stddev_samp(value) AS sd FROM e GROUP BY 1), z AS (SELECT sample_id, feature_id, (value - mean) / nullif(sd, 0) AS value FROM e JOIN m USING (feature_id))"
PAIRS = "pairs AS (SELECT a.feature_id AS i, b.feature_id AS j, sum(a.value * b.value) AS gram, covar_samp(a.value, b.value) AS cov, corr(a.value, b.value) AS corr FROM e a JOIN e b USING (sample_id) WHERE a.feature_id {op} b.feature_id GROUP BY 1, 2)"
R = "round({}, 6) + 0.0"
_rows = lambda rows: ", ".join(str(tuple(x)) for x in rows)
GRAPH_SQL = f"g(i, j, dist) AS (SELECT CAST(i AS BIGINT), CAST(j AS BIGINT), CAST(d AS DOUBLE) FROM (VALUES {_rows(GRAPH)}) t(i, j, d))"
MERGES_SQL = f"f(c1, c2, height, merged, merge_no) AS (SELECT CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(h AS DOUBLE), CAST(m AS BIGINT), CAST(k AS BIGINT) FROM (VALUES {_rows((*m, k) for k, m in enumerate(MERGES, 1))}) t(a, b, h, m, k))"
UP = "up AS (SELECT c1 AS id, merged AS parent FROM f WHERE {w} UNION ALL SELECT c2, merged FROM f WHERE {w})"
CLIMB = UP + ", climb AS (SELECT id, parent AS root FROM up UNION ALL SELECT c.id, u.parent FROM climb c JOIN up u ON c.root = u.id), top AS (SELECT id, max(root) AS root FROM climb GROUP BY 1 UNION ALL SELECT merged, merged FROM f WHERE {w} AND merged NOT IN (SELECT id FROM up))"
REMAP = "r AS (SELECT least(coalesce(a.root, i), coalesce(b.root, j)) AS i, greatest(coalesce(a.root, i), coalesce(b.root, j)) AS j, dist, CAST(1 AS BIGINT) AS w, (a.root IS NOT NULL OR b.root IS NOT NULL) AS changed FROM g LEFT JOIN top a ON a.id = i LEFT JOIN top b ON b.id = j WHERE coalesce(a.root, i) <> coalesce(b.root, j))"
SIZED = UP + ", climb AS (SELECT id AS leaf, parent AS id FROM up WHERE id <= 23 UNION ALL SELECT c.leaf, u.parent FROM climb c JOIN up u ON c.id = u.id), sizes AS (SELECT id, count(*) AS size FROM climb GROUP BY 1)"
HALF = "merge_no <= 6"
LABELS = "mods AS (SELECT vec_id % 5 + 1 AS tree_id, vec_id AS feature_id, CAST(label AS BIGINT) AS module FROM embeddings WHERE label IS NOT NULL)"
NUMBERS = LABELS + ", fst AS (SELECT tree_id, module, min(feature_id) AS f FROM mods GROUP BY 1, 2), tag AS (SELECT *, module = 0 AND count(*) OVER (PARTITION BY tree_id) > 1 AS back FROM fst), num AS (SELECT tree_id, module, CASE WHEN back THEN -row_number() OVER (PARTITION BY back ORDER BY tree_id, f) ELSE row_number() OVER (PARTITION BY back ORDER BY tree_id, f) END AS number FROM tag)"
TREE = UP.format(w="true") + ", adj AS (SELECT id AS a, parent AS b FROM up UNION ALL SELECT parent, id FROM up), walk AS (SELECT a, a AS b FROM adj UNION SELECT w.a, x.b FROM walk w JOIN adj x ON w.b = x.a), comp AS (SELECT a AS id, min(b) AS component FROM walk GROUP BY 1), mem AS (SELECT id, CAST(dense_rank() OVER (ORDER BY component) AS BIGINT) AS tree_id FROM comp)"
CODES = TREE + ", lab AS (SELECT tree_id, id, dense_rank() OVER (PARTITION BY tree_id ORDER BY id) AS label, id <= 23 AS leaf FROM mem), code AS (SELECT *, CASE WHEN leaf THEN -label ELSE label - sum(CASE WHEN leaf THEN 1 ELSE 0 END) OVER (PARTITION BY tree_id) END AS code FROM lab)"


def boost_sql(source: str = "z", steps: int = STEPS, until: int | None = None) -> str:
    """CTEs up to filt(i, j): the boosting filter of the matrix ``source``, one step after the other."""
    only = f" AND a.feature_id <= {until}" if until else ""
    parts = [
        f"gram AS MATERIALIZED (SELECT a.feature_id AS y, b.feature_id AS c, sum(a.value * b.value) AS nom FROM {source} a JOIN {source} b USING (sample_id) WHERE a.feature_id <> b.feature_id{only} GROUP BY 1, 2)",
        f"cov AS MATERIALIZED (SELECT a.feature_id AS s, b.feature_id AS c, covar_samp(a.value, b.value) AS cov FROM {source} a JOIN {source} b USING (sample_id) GROUP BY 1, 2)",
    ]
    best = "SELECT y, arg_max(c, (nom * nom, -c)) AS sel, arg_max(nom, (nom * nom, -c)) * 0.1 AS upd FROM {} GROUP BY y"
    parts.append(f"s0 AS MATERIALIZED ({best.format('gram')})")
    last = "gram"
    for k in range(1, steps):
        parts.append(f"n{k} AS MATERIALIZED (SELECT n.y, n.c, n.nom - s.upd * v.cov AS nom FROM {last} n JOIN s{k - 1} s ON s.y = n.y JOIN cov v ON v.s = s.sel AND v.c = n.c)")
        parts.append(f"s{k} AS MATERIALIZED ({best.format(f'n{k}')})")
        last = f"n{k}"
    union = " UNION ALL ".join(f"SELECT y, sel FROM s{k}" for k in range(steps))
    parts.append(f"filt AS MATERIALIZED (SELECT DISTINCT least(y, sel) AS i, greatest(y, sel) AS j FROM ({union}))")
    return ", ".join(parts)


def upgma_sql(table: str, top: int, merges: int, psi: float = 1.0) -> str:
    """CTEs up to forest(c1, c2, height, merged, merge_no): average linkage of (i, j, dist), one merge after the other."""
    parts = [f"e0 AS MATERIALIZED (SELECT i, j, dist FROM {table})", "sz0 AS MATERIALIZED (SELECT DISTINCT id, CAST(1 AS DOUBLE) AS n FROM (SELECT i AS id FROM e0 UNION ALL SELECT j FROM e0))"]
    for k in range(merges):
        new = f"CAST({top + k + 1} AS BIGINT)"
        parts += [
            f"b{k} AS MATERIALIZED (SELECT *, (SELECT n FROM sz{k} WHERE id = a) AS na, (SELECT n FROM sz{k} WHERE id = b) AS nb FROM (SELECT arg_min(i, (dist, -i, -j)) AS a, arg_min(j, (dist, -i, -j)) AS b, min(dist) AS h FROM e{k} HAVING count(*) > 0))",
            f"sz{k + 1} AS MATERIALIZED (SELECT id, n FROM sz{k}, b{k} WHERE id NOT IN (a, b) UNION ALL SELECT {new}, na + nb FROM b{k})",
            f"x{k} AS MATERIALIZED (SELECT CASE WHEN i IN (a, b) THEN j ELSE i END AS v, i = a OR j = a AS at_a, dist, na, nb FROM e{k}, b{k} WHERE (i IN (a, b)) <> (j IN (a, b)))",
            f"e{k + 1} AS MATERIALIZED (SELECT i, j, dist FROM e{k}, b{k} WHERE i NOT IN (a, b) AND j NOT IN (a, b) UNION ALL SELECT v, {new}, (na * coalesce(max(dist) FILTER (at_a), {psi}) + nb * coalesce(max(dist) FILTER (NOT at_a), {psi})) / (na + nb) FROM x{k} GROUP BY v, na, nb)",
        ]
    union = " UNION ALL ".join(f"SELECT a, b, h, CAST({top + k + 1} AS BIGINT), CAST({k + 1} AS BIGINT) FROM b{k}" for k in range(merges))
    return ", ".join(parts) + f", forest(c1, c2, height, merged, merge_no) AS ({union})"


ADJ = f"WITH {Z}, {boost_sql()}, adj AS MATERIALIZED (SELECT i, j, pow(abs(corr(a.value, b.value)), 3) AS adj FROM filt JOIN e a ON a.feature_id = i JOIN e b ON b.feature_id = j AND b.sample_id = a.sample_id GROUP BY 1, 2), nbr AS MATERIALIZED (SELECT i AS u, j AS v, adj AS a FROM adj UNION ALL SELECT j, i, adj FROM adj), k AS (SELECT u, sum(a) AS k, count(*) AS degree FROM nbr GROUP BY 1)"
TOM = "sh AS (SELECT i, j, sum(p.a * q.a) AS s FROM adj JOIN nbr p ON p.u = i JOIN nbr q ON q.u = j AND q.v = p.v GROUP BY 1, 2), tom AS MATERIALIZED (SELECT adj.i, adj.j, 1 - (coalesce(s, 0) + adj) / (least(x.k, y.k) + 1 - adj) AS dist FROM adj LEFT JOIN sh ON sh.i = adj.i AND sh.j = adj.j JOIN k x ON x.u = adj.i JOIN k y ON y.u = adj.j)"
PC = f"WITH {E}, c AS (SELECT (a.feature_id + 1) // 2 AS module, corr(a.value, b.value) AS r FROM e a JOIN e b ON a.sample_id = b.sample_id AND b.feature_id = a.feature_id + 1 WHERE a.feature_id % 2 = 1 GROUP BY 1), v AS (SELECT module, CAST(1 AS BIGINT) AS pc, (1 + abs(r)) / 2 AS share FROM c UNION ALL SELECT module, 2, (1 - abs(r)) / 2 FROM c)"
HOURS = "hours AS (SELECT epoch(date_trunc('hour', ts)) AS h, event_type FROM events), kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS feature_id FROM (SELECT DISTINCT event_type FROM hours)), e AS (SELECT h AS sample_id, feature_id, CAST((SELECT count(*) FROM hours x WHERE x.h = hh.h AND x.event_type = kk.event_type) AS DOUBLE) AS value FROM (SELECT DISTINCT h FROM hours) hh CROSS JOIN kinds kk)"
MEANS = f"{Z}, means AS (SELECT (feature_id - 1) // 8 + 1 AS module, sample_id, avg(value) AS value FROM z GROUP BY 1, 2)"
LONG_L = "e AS (SELECT l_orderkey * 10 + l_linenumber AS sample_id, CAST(k AS BIGINT) AS feature_id, [l_quantity, l_extendedprice, l_discount, l_tax][k] AS value FROM lineitem CROSS JOIN range(1, 5) t(k))"
FOREST = f"{ADJ.replace('WITH ', 'WITH RECURSIVE ', 1)}, {TOM}, {upgma_sql('tom', 64, 63)}, f AS MATERIALIZED (SELECT * FROM forest)"
#: Nodes of the forest by their way down from the root, leaves in order from left to right.
PATHS = "kid AS (SELECT merged AS parent, c1 AS id, '0' AS bit FROM f UNION ALL SELECT merged, c2, '1' FROM f), path AS (SELECT merged AS root, merged AS id, '' AS p FROM f WHERE merged NOT IN (SELECT id FROM kid) UNION ALL SELECT path.root, kid.id, path.p || kid.bit FROM path JOIN kid ON kid.parent = path.id), tree AS (SELECT root, CAST(dense_rank() OVER (ORDER BY min(id)) AS BIGINT) AS tree_id FROM path GROUP BY 1), leaf AS (SELECT root, id, p, row_number() OVER (PARTITION BY root ORDER BY p) AS pos FROM path WHERE id <= 64)"
BRACKETS = PATHS + ", x AS (SELECT n.root, n.id, sum(l.pos * pow(0.5, len(l.p) - len(n.p))) AS x FROM path n JOIN leaf l ON l.root = n.root AND starts_with(l.p, n.p) GROUP BY 1, 2), y AS (SELECT x.*, coalesce(f.height, 0) AS y FROM x LEFT JOIN f ON f.merged = x.id)"
EXPECTED = f"WITH {MERGES_SQL} SELECT c1, c2, {R.format('height')} AS height, merged, merge_no FROM f"
POWERS_SQL = ", ".join(f"({p})" for p in correlation.POWERS)

#: Illegal lines of t(line, content).
VALIDATED = "l AS (SELECT CAST(line AS BIGINT) AS line, content, regexp_matches(content, '^\\s*\\d+\\s+\\d+\\s+[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') AS ok FROM t), p AS (SELECT *, TRY_CAST(split_part(content, ' ', 1) AS BIGINT) AS a, TRY_CAST(split_part(content, ' ', 2) AS BIGINT) AS b FROM l), q AS (SELECT line, CASE WHEN NOT ok THEN 'format' WHEN a = 0 OR b = 0 THEN 'zero id' WHEN a = b THEN 'self edge' WHEN line > min(CASE WHEN ok THEN line END) OVER (PARTITION BY least(a, b), greatest(a, b)) THEN 'duplicate' END AS problem FROM p) SELECT line, problem FROM q WHERE problem IS NOT NULL"

SQL: dict[str, str] = {
    "q_scale": f"WITH {Z} SELECT sample_id, feature_id, {R.format('value')} AS value FROM z",
    "q_center": f"WITH {E} SELECT sample_id, feature_id, {R.format('value - avg(value) OVER (PARTITION BY feature_id)')} AS value FROM e",
    "q_scale_lineitem": f"WITH {LONG_L} SELECT sample_id, feature_id, {R.format('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)')} AS value FROM e WINDOW w AS (PARTITION BY feature_id)",
    "q_vectors": f"WITH {E} SELECT feature_id, count(*) AS n, {R.format('arg_min(value, sample_id)')} AS first, {R.format('arg_max(value, sample_id)')} AS last FROM e GROUP BY 1",
    "q_feature_subset": f"WITH {E} SELECT feature_id, count(*) AS n FROM e GROUP BY 1 HAVING avg(value) > 0",
    "q_gram": f"WITH {E}, {PAIRS.format(op='<=')} SELECT i, j, {R.format('gram')} AS gram FROM pairs",
    "q_cov": f"WITH {E}, {PAIRS.format(op='<=')} SELECT i, j, {R.format('cov')} AS cov FROM pairs",
    "q_corr_pairs": f"WITH {E}, {PAIRS.format(op='<')} SELECT i, j, {R.format('corr')} AS corr FROM pairs",
    "q_corr_lineitem": "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(r, 6) + 0.0 AS corr FROM ("
    + " UNION ALL ".join(f"SELECT {a + 1} AS i, {b + 1} AS j, corr({L_COLUMNS[a]}, {L_COLUMNS[b]}) AS r FROM lineitem" for a in range(4) for b in range(a + 1, 4))
    + ")",
    "q_corr_events": f"WITH {HOURS}, {PAIRS.format(op='<')} SELECT i, j, {R.format('cov')} AS cov, {R.format('corr')} AS corr FROM pairs",
    "q_spearman": f"WITH {E}, r AS (SELECT sample_id, feature_id, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS rnk FROM e) SELECT a.feature_id AS i, b.feature_id AS j, {R.format('corr(a.rnk, b.rnk)')} AS corr FROM r a JOIN r b USING (sample_id) WHERE a.feature_id < b.feature_id GROUP BY 1, 2",
    "q_kendall": f"WITH {HOURS}, d AS (SELECT a.feature_id, a.sample_id AS s, b.sample_id AS t, sign(a.value - b.value) AS d FROM e a JOIN e b USING (feature_id)) SELECT x.feature_id AS i, y.feature_id AS j, {R.format('sum(x.d * y.d) / sqrt(CAST(sum(x.d * x.d) AS DOUBLE) * sum(y.d * y.d))')} AS corr FROM d x JOIN d y USING (s, t) WHERE x.feature_id < y.feature_id GROUP BY 1, 2",
    "q_boost_filter": f"WITH {Z}, {boost_sql()} SELECT i, j FROM filt",
    "q_boost_unscaled": f"WITH {E}, {boost_sql('e')} SELECT i, j FROM filt",
    "q_boost_until": f"WITH {Z}, {boost_sql(until=16)} SELECT i, j FROM filt",
    "q_adjacency": f"{ADJ} SELECT i, j, {R.format('adj * 1000')} AS adj_milli FROM adj",
    "q_strength": f"{ADJ} SELECT u, {R.format('k')} AS k, degree FROM k",
    "q_common_neighbours": f"{ADJ} SELECT i, j, count(*) AS n_common FROM adj JOIN nbr p ON p.u = i JOIN nbr q ON q.u = j AND q.v = p.v GROUP BY 1, 2",
    "q_tom_dist": f"{ADJ}, {TOM} SELECT i, j, {R.format('dist')} AS dist FROM tom",
    "q_upgma_matrix": f"{ADJ}, {TOM}, {upgma_sql('tom', 64, 63)} SELECT c1, c2, {R.format('height')} AS height, merged, merge_no FROM forest",
    "q_top_m_edges": f"WITH {E}, {PAIRS.format(op='<')} SELECT i, j, {R.format('round(1 - abs(corr), 9)')} AS dist FROM pairs ORDER BY round(1 - abs(corr), 9), i, j LIMIT 500",
    "q_soft_power_table": f"WITH {E}, {PAIRS.format(op='<')}, bth AS (SELECT i, corr FROM pairs UNION ALL SELECT j, corr FROM pairs), k AS (SELECT CAST(p AS BIGINT) AS power, i, sum(pow(abs(corr), p)) AS k FROM bth CROSS JOIN (VALUES {POWERS_SQL}) t(p) GROUP BY 1, 2), b AS (SELECT *, min(k) OVER w AS lo, max(k) OVER w AS hi, count(*) OVER w AS n, avg(k) OVER w AS mean_k FROM k WINDOW w AS (PARTITION BY power)), c AS (SELECT power, k, n, mean_k, coalesce(least(9, floor((k - lo) / nullif((hi - lo) / 10, 0))), 0) AS bin FROM b), pt AS (SELECT power, bin, log10(avg(k)) AS x, log10(count(*) / max(n)) AS y, max(mean_k) AS mean_k FROM c GROUP BY 1, 2) SELECT power, {R.format('regr_r2(y, x)')} AS r2, {R.format('regr_slope(y, x)')} AS slope, {R.format('-sign(regr_slope(y, x)) * regr_r2(y, x)')} AS signed_r2, {R.format('max(mean_k)')} AS mean_k FROM pt GROUP BY 1",
    "q_edge_validate": f"WITH t(line, content) AS (VALUES {_rows(enumerate(LINES, 1))}), {VALIDATED}",
    "q_edge_validate_rows": f"WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS line, (l_orderkey % 90) || ' ' || (l_partkey % 90) || ' ' || CASE WHEN l_quantity % 7 = 0 THEN 'x' ELSE '' END || CAST(l_quantity AS BIGINT) AS content FROM lineitem), {VALIDATED}",
    "q_edge_file": f"{ADJ}, {TOM} SELECT i, j, {R.format('dist')} AS lb, {R.format('dist')} AS ub FROM tom",
    "q_weighted_file": f"{ADJ}, {TOM} SELECT i, j, {R.format('dist * (i + j)')} AS sum_d, i + j AS w FROM tom",
    "q_split_file": f"{ADJ} SELECT i, j, {R.format('adj * 1000')} AS adj_milli FROM adj",
    "q_forest_file": f"{FOREST} SELECT c1, c2, {R.format('height')} AS height, merged FROM f",
    "q_sizes_file": f"{FOREST}, {PATHS} SELECT n.id, count(*) AS size FROM path n JOIN leaf l ON l.root = n.root AND starts_with(l.p, n.p) WHERE n.id > 64 GROUP BY 1",
    "q_forest_roots": f"{FOREST}, {PATHS} SELECT id, root FROM path",
    "q_forest_dendrogram": f"{FOREST}, {PATHS}, codes AS (SELECT tree_id, id, CASE WHEN id <= 64 THEN -row_number() OVER (PARTITION BY root, id <= 64 ORDER BY id) ELSE row_number() OVER (PARTITION BY root, id <= 64 ORDER BY id) END AS code FROM path JOIN tree USING (root)) SELECT m.tree_id, m.code AS step, a.code AS left, b.code AS right, {R.format('height')} AS height FROM f JOIN codes a ON a.id = c1 JOIN codes b ON b.id = c2 JOIN codes m ON m.id = merged",
    "q_leaf_order": f"{FOREST}, {PATHS} SELECT tree_id, pos, id AS feature_id FROM leaf JOIN tree USING (root)",
    "q_plot_segments": f"{FOREST}, {BRACKETS} SELECT tree_id, row_number() OVER (PARTITION BY m.root ORDER BY merged) AS step, {R.format('a.x')} AS x0, {R.format('b.x')} AS x1, {R.format('a.y')} AS y0, {R.format('b.y')} AS y1, {R.format('height')} AS y FROM f JOIN y a ON a.id = c1 JOIN y b ON b.id = c2 JOIN y m ON m.id = merged JOIN tree ON tree.root = m.root",
    "q_round_totals": f"{FOREST} SELECT (SELECT count(*) FROM tom) AS n_edges, count(*) AS merges, {R.format('max(height)')} AS max_height, true AS shrinks FROM f",
    "q_scientific_edges": f"WITH {GRAPH_SQL} SELECT printf('%8d\t%8d\t%.6e', i, j, dist) AS line FROM g",
    "q_max_singleton": f"WITH {GRAPH_SQL} SELECT max(greatest(i, j)) AS max_singleton FROM g",
    "q_components": f"WITH RECURSIVE {E}, {PAIRS.format(op='<')}, adj AS MATERIALIZED (SELECT i AS a, j AS b FROM pairs WHERE abs(corr) > 0.12 UNION ALL SELECT j, i FROM pairs WHERE abs(corr) > 0.12), walk AS (SELECT a, b FROM adj UNION SELECT w.a, x.b FROM walk w JOIN adj x ON w.b = x.a) SELECT a AS node, least(a, min(b)) AS component FROM walk GROUP BY 1",
    "q_remap_roots": f"WITH RECURSIVE {MERGES_SQL}, {CLIMB.format(w=HALF)} SELECT id, root FROM top",
    "q_cluster_sizes": f"WITH RECURSIVE {MERGES_SQL}, {SIZED.format(w='true')} SELECT id, size FROM sizes",
    "q_existing_vs_changed": f"WITH RECURSIVE {MERGES_SQL}, {GRAPH_SQL}, {CLIMB.format(w=HALF)}, {REMAP} SELECT i, j, {R.format('dist')} AS dist, w, changed FROM r",
    "q_collate": f"WITH RECURSIVE {MERGES_SQL}, {GRAPH_SQL}, {CLIMB.format(w=HALF)}, {REMAP} SELECT i, j, {R.format('sum(dist * w)')} AS sum_d, CAST(sum(w) AS BIGINT) AS w FROM r GROUP BY 1, 2",
    "q_thicken": f"WITH RECURSIVE {MERGES_SQL}, {GRAPH_SQL}, {CLIMB.format(w=HALF)}, {REMAP}, lv AS (SELECT root AS id, count(*) AS size FROM top WHERE id <= 23 GROUP BY 1), s AS (SELECT r.i, r.j, sum(dist * w) AS d, sum(w) AS w FROM r GROUP BY 1, 2) SELECT s.i, s.j, {R.format('((coalesce(a.size, 1) * coalesce(b.size, 1) - w) * 100.0 + d) / (coalesce(a.size, 1) * coalesce(b.size, 1))')} AS dist FROM s LEFT JOIN lv a ON a.id = s.i LEFT JOIN lv b ON b.id = s.j",
    "q_weighted_mean": f"WITH {GRAPH_SQL} SELECT i, j, {R.format('dist * i / i')} AS mean, i AS w FROM g",
    "q_upgma_small": EXPECTED,
    "q_upgma_rounds_small": EXPECTED,
    "q_upgma_reciprocal_small": EXPECTED,
    "q_upgma_rounds": f"{ADJ}, {TOM}, {upgma_sql('tom', 64, 63)} SELECT c1, c2, {R.format('height')} AS height, merged, merge_no FROM forest",
    "q_upgma_reciprocal": f"{ADJ}, {TOM}, {upgma_sql('tom', 64, 63)} SELECT c1, c2, {R.format('height')} AS height, merged, merge_no FROM forest",
    "q_trees": f"WITH RECURSIVE {MERGES_SQL}, {TREE} SELECT tree_id, string_agg(id, ',' ORDER BY id) AS ids, (SELECT string_agg(merge_no, ',' ORDER BY merge_no) FROM f JOIN mem x ON x.id = f.merged WHERE x.tree_id = mem.tree_id) AS rows FROM mem GROUP BY 1",
    "q_tree_relabel": f"WITH RECURSIVE {MERGES_SQL}, {CODES} SELECT tree_id, id, label, leaf FROM lab",
    "q_dendrogram": f"WITH RECURSIVE {MERGES_SQL}, {CODES} SELECT m.tree_id, CAST(m.code AS BIGINT) AS step, CAST(a.code AS BIGINT) AS left, CAST(b.code AS BIGINT) AS right, {R.format('height')} AS height FROM f JOIN code a ON a.id = c1 JOIN code b ON b.id = c2 JOIN code m ON m.id = merged",
    "q_round_thresholds": f"WITH {MERGES_SQL}, r AS (SELECT f.*, CAST([{', '.join(map(str, ROUNDS))}][merge_no] AS BIGINT) AS round FROM f) SELECT round, {R.format('arg_max(height, merged)')} AS height, max(merged) AS merged FROM r GROUP BY 1",
    "q_merge_counts": f"WITH {MERGES_SQL}, r AS (SELECT f.*, CAST([{', '.join(map(str, ROUNDS))}][merge_no] AS BIGINT) AS round FROM f) SELECT round, count(*) AS n, {R.format('max(height)')} AS max_height FROM r GROUP BY 1",
    "q_linkage_rules": f"WITH {GRAPH_SQL}, x AS (SELECT CAST(i AS DOUBLE) AS n1, CAST(j AS DOUBLE) AS n2, dist AS v1, dist + 7 AS v2 FROM g WHERE i > 4) SELECT n1, n2, {R.format('(n1 * v1 + n2 * v2) / (n1 + n2)')} AS arithmetic, {R.format('pow(v1, n1 / (n1 + n2)) * pow(v2, n2 / (n1 + n2))')} AS geometric, {R.format('(n1 + n2) / (n1 / v1 + n2 / v2)')} AS harmonic, {R.format('least(v1, v2)')} AS minimum, {R.format('greatest(v1, v2)')} AS maximum FROM x",
    "q_module_sizes": f"WITH {LABELS} SELECT module, count(*) AS size FROM mods GROUP BY 1",
    "q_module_numbering": f"WITH {NUMBERS} SELECT tree_id, module, number FROM num",
    "q_summary_stats": f"WITH {NUMBERS}, s AS (SELECT number, count(*) AS size FROM mods JOIN num USING (tree_id, module) GROUP BY 1) SELECT count(*) FILTER (number > 0) AS n_modules, count(*) FILTER (number <= 0) AS n_background, {R.format('avg(size) FILTER (number > 0)')} AS mean_size, CAST(coalesce(sum(size) FILTER (number <= 0), 0) AS BIGINT) AS n_unassigned, {R.format('coalesce(sum(size) FILTER (number <= 0), 0) * 100.0 / sum(size)')} AS pct_unassigned FROM s",
    "q_colour_ranks": f"WITH {NUMBERS}, k AS (SELECT number AS module, row_number() OVER (ORDER BY number) - 1 AS k, count(*) OVER () AS n FROM num WHERE number > 0) SELECT module, CAST(CASE WHEN k < ceil(n / 2) THEN k * 2 ELSE (k - ceil(n / 2)) * 2 + 1 END AS BIGINT) AS rank FROM k",
    "q_me_labels": f"WITH {NUMBERS} SELECT number, CASE WHEN number > 0 THEN 'ME' || number || '_pc2' ELSE 'ME0_' || -number || '_pc2' END AS label, number AS module, CAST(2 AS INTEGER) AS pc FROM num",
    "q_pc_var_explained": f"{PC} SELECT module, pc, {R.format('share')} AS share FROM v",
    "q_module_validity": f"WITH {E}, s AS (SELECT (feature_id + 1) // 2 AS module, min(sd) > 0 AS valid FROM (SELECT feature_id, stddev_samp(CASE WHEN feature_id % 5 = 0 THEN 1.0 ELSE value END) AS sd FROM e GROUP BY 1) GROUP BY 1) SELECT CAST(1 AS BIGINT) AS tree_id, module, valid, valid AS is_pc, false AS is_hub, valid AS valid_average FROM s",
    "q_pc_scores": f"WITH {Z}, c AS (SELECT (a.feature_id + 1) // 2 AS module, a.sample_id, a.value AS x, b.value AS y FROM z a JOIN z b ON a.sample_id = b.sample_id AND b.feature_id = a.feature_id + 1 WHERE a.feature_id % 2 = 1), s AS (SELECT *, x + sign(corr(x, y) OVER (PARTITION BY module)) * y AS t FROM c) SELECT module, sample_id, {R.format('t * t / sum(t * t) OVER (PARTITION BY module) * 1000')} AS square_milli FROM s",
    "q_cum_pcs": f"{PC} SELECT module, CASE WHEN share > 0.52 THEN CAST(1 AS BIGINT) ELSE 2 END AS n_pcs FROM v WHERE pc = 1",
    "q_avg_expr": f"WITH {MEANS} SELECT module, sample_id, {R.format('value')} AS value FROM means",
    "q_me_dissim": f"WITH {MEANS} SELECT 'ME' || a.module || '_pc1' AS a, 'ME' || b.module || '_pc1' AS b, {R.format('1 - corr(a.value, b.value)')} AS diss FROM means a JOIN means b USING (sample_id) GROUP BY 1, 2",
    "q_transfer": f"WITH {E} SELECT sample_id, (feature_id - 1) // 8 + 1 AS module, {R.format('sum(value * (feature_id % 8 + 1) / 10)')} AS value FROM e GROUP BY 1, 2",
    "q_transfer_by_name": f"WITH {Z} SELECT sample_id, (feature_id - 1) // 8 + 1 AS module, {R.format('sum(value * (feature_id % 8 + 1) / 10)')} AS value FROM z GROUP BY 1, 2",
    "q_dense_rotation": f"WITH {E}, f AS (SELECT DISTINCT feature_id FROM e), m AS (SELECT DISTINCT (feature_id - 1) // 8 + 1 AS module FROM f) SELECT feature_id, module, {R.format('CASE WHEN (feature_id - 1) // 8 + 1 = module THEN feature_id / 10 ELSE 0.0 END')} AS loading FROM f CROSS JOIN m",
    "q_name_set_check": "SELECT true AS same, (SELECT count(*) FROM (SELECT CAST(r_regionkey AS VARCHAR) FROM region EXCEPT ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation)) + (SELECT count(*) FROM (SELECT CAST(n_regionkey AS VARCHAR) FROM nation EXCEPT ALL SELECT CAST(r_regionkey AS VARCHAR) FROM region)) = 0 AS other",
    "q_anti_ids": f"WITH {MERGES_SQL} SELECT CAST(k AS BIGINT) AS id FROM range(1, 24) t(k) WHERE k NOT IN (SELECT c1 FROM f UNION SELECT c2 FROM f UNION SELECT merged FROM f)",
    "q_transposed": f"WITH {E} SELECT sample_id AS feature_id, {R.format('sum(value)')} AS total FROM e GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
