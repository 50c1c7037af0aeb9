import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import boosting, eigengenes
from weft.operators.correlation import edge_correlation, kendall, pick_soft_power
from weft.operators.modules import average_linkage_groups, cut_trees, dynamic_cut
from weft.operators.scaling import scale
from weft.plans.pipeline import Model, Params, fit
from weft.sources import matrix


def planted(seed=0, n=60, k=4, each=8, noise=10):
    rng = np.random.default_rng(seed)
    factors = rng.standard_normal((n, k))
    return np.hstack([factors[:, [f]] + 0.4 * rng.standard_normal((n, each)) for f in range(k)] + [rng.standard_normal((n, noise))])


def long_of(spark, x):
    rows = [(a, b + 1, float(x[a, b])) for a in range(x.shape[0]) for b in range(x.shape[1])]
    dim = spark.createDataFrame([(k + 1, f"f{k}") for k in range(x.shape[1])], "feature_id long, name string")
    return spark.createDataFrame(rows, "sample_id long, feature_id long, value double"), dim


@pytest.fixture(scope="module")
def fitted(spark):
    long, dim = long_of(spark, planted())
    return long, dim, fit(long, dim, Params(soft_power=3, min_cluster_size=3, n_pc=2))


def boost_loop(x, steps):
    z, n = x - x.mean(axis=0), len(x)
    out = set()
    for y in range(x.shape[1]):
        nom = x.T @ x[:, y]
        nom[y] = 0
        for s in range(steps):
            if s:
                nom = nom - upd * (z.T @ z[:, sel]) / (n - 1)  # noqa: F821
                nom[y] = 0
            sel = int(np.argmax(nom**2))
            upd = 0.1 * nom[sel]
            out.add((y + 1, sel + 1))
    return out


def test_boosting_three_ways(spark):
    x = planted(1, 30, 2, 5, 6)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    long, _ = long_of(spark, x)
    want = boost_loop(x, 6)
    got = {(r.y, r.c) for r in boosting.selections(long, 6).collect()}
    assert got == want
    assert {(r.y, r.c) for r in boosting.selections(long, 6, broadcast_bytes=0).collect()} == want
    assert {(r.y, r.c) for r in boosting.selections_by_joins(long, 6).collect()} == want


@pytest.mark.parametrize("bad", [{"stepno": 0}, {"stepno": 1.5}, {"until": -1}])
def test_boosting_arguments(spark, bad):
    long, _ = long_of(spark, planted(1, 5, 1, 2, 1))
    with pytest.raises(ValueError):
        boosting.selections(long, **{"stepno": 3, "until": 0} | bad)


def test_planted_modules_are_found(fitted):
    _, _, model = fitted
    groups = {}
    for r in model.modules.collect():
        groups.setdefault(r.module, set()).add(r.feature_id)
    for k in range(4):
        best = max((g for m, g in groups.items() if m > 0), key=lambda g: len(g & set(range(8 * k + 1, 8 * k + 9))))
        assert len(best & set(range(8 * k + 1, 8 * k + 9))) >= 6 and len(best) <= 9
    assert sum(map(len, groups.values())) == 42


def test_transfer_gives_back_the_scores(spark, fitted, tmp_path):
    long, dim, model = fitted
    want = {(r.sample_id, r.module, r.pc): r.value for r in model.scores.collect()}
    for got in (model.transfer(scale(long), dim), model.transfer(long, dim, scaled=True)):
        rows = {(r.sample_id, r.module, r.pc): r.value for r in got.collect()}
        assert rows.keys() == want.keys() and max(abs(rows[k] - want[k]) for k in want) < 1e-12
    anew = {(r.sample_id, r.module, r.pc): r.value for r in model.transfer(long, dim, only_module_membership=True).collect()}
    assert anew.keys() == want.keys() and max(abs(anew[k] - want[k]) for k in want) < 1e-9
    model.save(str(tmp_path / "model"))
    again = Model.load(spark, str(tmp_path / "model"))
    assert again.modules.exceptAll(model.modules).isEmpty()
    renamed = dim.withColumn("name", F.concat(F.lit("x"), "name"))
    for bad in (renamed, dim.limit(3)):
        with pytest.raises(ValueError):
            model.transfer(long, bad)
    with pytest.raises(ValueError):
        model.transfer(long.limit(0), dim)


def test_streaming_transfer(spark, fitted, tmp_path):
    from weft.streaming.transfer import project_stream

    long, _, model = fitted
    samples = scale(long).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("p")).select("sample_id", F.col("p.value").alias("vec"))
    samples.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_id long, vec array<double>").parquet(str(tmp_path / "in"))
    query = project_stream(stream, model.rotation, 42).writeStream.format("memory").queryName("projected").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = {(r.sample_id, r.module, r.pc): r.value for r in model.scores.collect()}
    got = {(r.sample_id, r.module, r.pc): r.value for r in spark.table("projected").collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_clusterers_and_automatic_power(spark, fitted):
    long, dim, model = fitted
    sizes = sorted(r["count"] for r in model.modules.groupBy("module").count().collect())
    for c in ("rounds", "reciprocal"):
        other = fit(long, dim, Params(soft_power=3, min_cluster_size=3, n_pc=2, clusterer=c, edges_in_memory=40))
        assert sorted(r["count"] for r in other.modules.groupBy("module").count().collect()) == sizes
    flat = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.1), (2, 3, 0.1)], "i long, j long, corr double")
    with pytest.raises(ValueError):
        pick_soft_power(flat)


@pytest.mark.parametrize("bad", [{"stepno": 0}, {"until": -1}, {"method": "x"}, {"min_cluster_size": 1.5}, {"me_diss_thres": "a"}, {"soft_power": -1}, {"clusterer": "x"}, {"n_pc": 0}])
def test_arguments(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_matrix_checks(spark):
    long, dim = long_of(spark, planted(2, 6, 1, 2, 1))
    for bad in (long.limit(0), long.withColumn("value", F.lit("x")), long.drop("value")):
        with pytest.raises(ValueError):
            matrix.validate(bad)
    with pytest.raises(ValueError):
        fit(long.withColumn("value", F.lit(1.0)), dim, Params(soft_power=2))
    wide = matrix.to_wide(long, [(1, "a"), (2, "b"), (3, "c")])
    back, names = matrix.from_wide(wide, "sample_id")
    assert back.exceptAll(long).isEmpty() and [r.name for r in names.orderBy("feature_id").collect()] == ["a", "b", "c"]
    assert matrix.sample_features(dim, 2, 5).collect() == matrix.sample_features(dim.repartition(3), 2, 5).collect()


def test_components_of_modules(spark):
    x = planted(4, 25, 2, 4, 1)
    long, dim = long_of(spark, x)
    mods = dim.select("feature_id", F.when(F.col("feature_id") <= 4, 1).when(F.col("feature_id") <= 8, 2).otherwise(0).cast("long").alias("module"))
    found = eigengenes.principal_components(mods, long, n_pc=25, min_var_explained=1.1)
    total = {r.module: r.t for r in found.var_explained.groupBy("module").agg(F.sum("share").alias("t")).collect()}
    assert total[1] == pytest.approx(1) and total[2] == pytest.approx(1)
    assert {r.module for r in eigengenes.principal_components(mods, long, exclude_grey=True).scores.collect()} == {1, 2}
    with pytest.raises(ValueError):
        eigengenes.principal_components(mods.withColumn("module", F.lit(0).cast("long")), long, exclude_grey=True)
    constant = long.withColumn("value", F.when(F.col("feature_id") == 2, 1.0).otherwise(F.col("value")))
    trapped = eigengenes.principal_components(mods, constant, trap_errors=True)
    assert [r.module for r in trapped.invalid.collect()] == [1]
    aligned = eigengenes.principal_components(mods, long, aligned=True)
    both = aligned.scores.where("pc = 1").withColumnRenamed("value", "s").join(aligned.average, ["module", "sample_id"])
    assert all(r.c > 0 for r in both.groupBy("module").agg(F.corr("s", "value").alias("c")).collect())


def kendall_brute(x, y):
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())


def test_rank_correlations(spark):
    rng = np.random.default_rng(0)
    for n in (2, 3, 17, 100):
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 12, n).astype(float)
        if len(set(x)) > 1 and len(set(y)) > 1:
            assert kendall(x, y) == pytest.approx(kendall_brute(x, y))
    long, _ = long_of(spark, planted(3, 12, 1, 2, 1))
    e = spark.createDataFrame([(1, 2)], "i long, j long")
    with pytest.raises(ValueError):
        edge_correlation(e, long, "cosine")


def test_cutting_a_tree(spark):
    left, right = np.array([-1, -3, 1, -5, 3]), np.array([-2, -4, 2, -6, 4])
    height = np.array([0.1, 0.12, 0.9, 0.15, 0.995])
    assert dynamic_cut(left, right, height, 2) in ({1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3},)
    assert set(dynamic_cut(left, right, height, 7).values()) == {0}
    groups = average_linkage_groups(np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]]), 0.25)
    assert groups[0] == groups[1] != groups[2]
    with pytest.raises(ValueError):
        cut_trees(None, None, 3, 0)
