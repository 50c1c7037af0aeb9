"""Steps of the fit on matrices of more samples than features: no task holds all samples of a module or of a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_model import boost_loop, kendall_brute, long_of, planted
from weft.operators import boosting, correlation, eigengenes, modules, products, scaling


@pytest.fixture(scope="module")
def matrix(spark):
    x = planted(7, 80, 3, 4, 2)
    x[:, 3] += 1e6
    long, dim = long_of(spark, x)
    return x, long, dim


def largest_batch(monkeypatch):
    """Kernels that see a whole module fail."""

    def fail(*_):
        raise AssertionError("a module in one task")

    monkeypatch.setattr(eigengenes, "_module", lambda *_: lambda pdf: fail())


def test_products(matrix):
    x, long, _ = matrix
    found = products.products(products.sample_rows(long.repartition(7)), products.feature_stats(long))
    z = x - x.mean(axis=0)
    assert found.n == 80 and np.allclose(found.raw, x.T @ x, rtol=1e-12) and np.allclose(found.centred, z.T @ z, rtol=1e-8, atol=1e-8)
    with pytest.raises(Exception, match="twice"):
        products.products(products.sample_rows(long.unionByName(long.limit(1))), products.feature_stats(long))


def test_boosting_by_products_and_by_vectors(spark, matrix):
    for x in (planted(7, 80, 3, 4, 2), planted(8, 9, 2, 5, 3)):  # the second has more features than samples
        long, _ = long_of(spark, x)
        assert {(r.y, r.c) for r in boosting.selections(long, 5).collect()} == boost_loop(x, 5)
    with pytest.raises(ValueError, match="lacks samples"):
        boosting.selections(matrix[1].where("sample_id > 0 or feature_id > 1"), 5)


def test_correlation_in_every_form(spark, matrix, monkeypatch):
    x, long, _ = matrix
    e = spark.createDataFrame([(1, 2), (2, 4), (4, 14), (1, 99)], "i long, j long")
    pair = lambda df: {(r.i, r.j): r.corr for r in df.collect()}
    want = {k: np.corrcoef(x[:, k[0] - 1], x[:, k[1] - 1])[0, 1] for k in ((1, 2), (2, 4), (4, 14))}
    assert pair(correlation.edge_correlation(e, long)) == pytest.approx(want)
    rank = {k: np.corrcoef(*(np.argsort(np.argsort(x[:, c - 1])) for c in k))[0, 1] for k in want}
    assert pair(correlation.edge_correlation(e, long, "spearman")) == pytest.approx(rank)
    tau = {k: kendall_brute(x[:, k[0] - 1], x[:, k[1] - 1]) for k in want}
    monkeypatch.setattr(correlation, "PIECE", 16)
    assert pair(correlation.edge_correlation(e, long, "kendall")) == pytest.approx(tau)
    monkeypatch.setattr(products, "MOST_FEATURES", 3)
    assert pair(correlation.edge_correlation(e, long)) == pytest.approx(want)


@pytest.mark.parametrize("scale", [True, False])
@pytest.mark.parametrize("aligned", [True, False])
def test_components_of_large_modules(matrix, monkeypatch, scale, aligned):
    _, long, dim = matrix
    mods = dim.select((F.col("feature_id") % 2).alias("tree_id"), "feature_id", F.when(F.col("feature_id") <= 6, 1).otherwise(2).cast("long").alias("module"))
    of = lambda c: [{tuple(r)[:-1]: r[-1] for r in df.collect()} for df in (c.scores, c.rotation, c.var_explained, c.average)]
    options = {"n_pc": 2, "min_var_explained": 0.99, "scale": scale, "aligned": aligned}
    want = of(eigengenes.principal_components(mods, long, **options))
    largest_batch(monkeypatch)
    for got, ref in zip(of(eigengenes.principal_components(mods, long, task_cells=10, **options)), want, strict=True):
        assert got.keys() == ref.keys() and all(got[k] == pytest.approx(ref[k], rel=1e-6, abs=1e-8) for k in ref)


def test_large_modules_that_cannot_be_decomposed(matrix, monkeypatch):
    _, long, dim = matrix
    mods = dim.select("feature_id", F.when(F.col("feature_id") <= 6, 1).when(F.col("feature_id") <= 9, 2).otherwise(3).cast("long").alias("module"))
    bad = long.withColumn("value", F.when(F.col("feature_id") == 2, 0.1).when((F.col("feature_id") == 8) & (F.col("sample_id") == 5), None).otherwise(F.col("value")))
    largest_batch(monkeypatch)
    found = eigengenes.principal_components(mods, bad, trap_errors=True, task_cells=10)
    assert sorted(r.module for r in found.invalid.collect()) == [1, 2]
    assert {r.module for r in found.scores.collect()} == {3}
    with pytest.raises(ValueError, match="constant"):
        eigengenes.principal_components(mods.where("module = 1"), bad, task_cells=10)


def test_large_modules_of_other_samples(matrix, monkeypatch):
    _, long, dim = matrix
    mods = dim.select("feature_id", F.least(F.lit(3), F.expr("(feature_id + 3) div 4")).cast("long").alias("module"))
    some = long.where("feature_id > 8 or feature_id <= 4 and sample_id < 50 or feature_id > 4 and sample_id >= 30")
    rows = lambda c: {(r.module, r.sample_id): abs(r.value) for r in c.scores.collect()}
    want = rows(eigengenes.principal_components(mods, some))
    largest_batch(monkeypatch)
    assert rows(eigengenes.principal_components(mods, some, task_cells=10)) == pytest.approx(want, abs=1e-8)


def test_merging_by_products(matrix, monkeypatch):
    _, long, dim = matrix
    mods = dim.select(F.lit(1).cast("long").alias("tree_id"), "feature_id", F.expr("(feature_id + 1) div 2").alias("module"))
    rows = lambda df: sorted(tuple(r) for r in df.select("tree_id", "feature_id", "module").collect())
    want = rows(modules.merge_close(mods, long))
    assert len({m for _, _, m in want}) < 7
    largest_batch(monkeypatch)
    monkeypatch.setattr(modules, "_close", lambda _: lambda pdf: 1 / 0)
    assert rows(modules.merge_close(mods, long, task_cells=10)) == want


@pytest.mark.parametrize("most", [0, 100])
def test_scaling_where_values_are(spark, matrix, monkeypatch, most):
    x, long, _ = matrix
    monkeypatch.setattr(scaling, "BROADCAST_FEATURES", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f, want in ((scaling.scale, (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)), (scaling.center, x - x.mean(axis=0))):
            got = f(long)
            assert ("SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
            values = {(r.sample_id, r.feature_id): r.value for r in got.collect()}
            assert len(values) == x.size and all(v == pytest.approx(want[a, b - 1], rel=1e-6, abs=1e-8) for (a, b), v in values.items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
