"""Componentwise boosting as an edge filter.

For each target feature: start from its inner products with all others (raw
values); every step selects the feature with the largest squared product,
then subtracts nu times that product times the covariance (centred values)
with the selected feature. The distinct selections are the target's edges.

With more samples than features the products of all features are summed once
and the steps need nothing else. Otherwise state is kept in sample space:
after some steps the product with feature c is X_c . X_y - Z_c . R_y, with R_y
the sum of the updates times Z_sel / (n - 1). So a step is one matrix product
with an arg-max, and targets are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.products import feature_stats, fits, products, sample_rows
from weft.sources.matrix import MAX_FEATURES, to_vectors
from weft.storage import discard, materialise

NU = 0.1
#: A matrix up to this size is broadcast; a larger one is met block by block.
BROADCAST_BYTES = 256 << 20
#: Features to a block, and bytes of it.
BLOCK = 512
BLOCK_BYTES = 32 << 20
TINY = np.finfo(float).tiny


def _check(stepno: int, until: int) -> None:
    if not isinstance(stepno, int) or stepno <= 0:
        raise ValueError("stepno must be an integer above 0")
    if not isinstance(until, int) or until < 0:
        raise ValueError("until must be an integer, 0 or above")


def _select(nom: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Row of the largest square in each column, the first on ties; the last selection where none exceeds the floor."""
    square = np.where(np.isnan(nom), -1.0, nom * nom)
    best = square.argmax(axis=0)
    return np.where(square[best, np.arange(nom.shape[1])] > TINY, best, last)


def _boost(nom: np.ndarray, targets: np.ndarray, centred: Callable[[np.ndarray], np.ndarray], n: int, stepno: int) -> np.ndarray:
    """(targets, stepno) selections from the products with the targets; ``centred`` gives centred products with features."""
    cols = np.arange(len(targets))
    nom[targets, cols] = np.nan  # a feature isn't its own candidate
    last = np.where(targets == 0, min(1, len(nom) - 1), 0)
    out = np.empty((len(targets), stepno), np.int64)
    for step in range(stepno):
        if step:
            nom -= update * centred(last) / (n - 1)  # noqa: F821
        last = _select(nom, last)
        update = NU * nom[last, cols]
        out[:, step] = last
    return out


def boost_block(x: np.ndarray, z: np.ndarray, targets: np.ndarray, stepno: int) -> np.ndarray:
    """(targets, stepno) selections, as columns of x, of the targets (columns of x)."""
    return _boost(x.T @ x[:, targets], targets, lambda last: z.T @ z[:, last], len(x), stepno)


def _chosen(pdf: pd.DataFrame, ids: np.ndarray, stepno: int, boost: Callable[[np.ndarray], np.ndarray]) -> Iterator[pd.DataFrame]:
    for k in range(0, len(pdf), 64):
        own = np.searchsorted(ids, pdf["feature_id"].to_numpy()[k : k + 64])
        yield pd.DataFrame({"y": ids[own].repeat(stepno), "c": ids[boost(own)].ravel()}).drop_duplicates()


def _kernel(shared, stepno: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, raw, n = shared.value
        x = np.frombuffer(raw, float).reshape(-1, n).T
        z = x - x.mean(axis=0)
        for pdf in batches:
            yield from _chosen(pdf, ids, stepno, lambda own: boost_block(x, z, own, stepno))

    return run


def _products_kernel(shared, stepno: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, raw, centred, n = shared.value
        for pdf in batches:
            yield from _chosen(pdf, ids, stepno, lambda own: _boost(raw[:, own], own, lambda last: centred[:, last], n, stepno))

    return run


def selections(long: DataFrame, stepno: int = 20, until: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(y, c): the features c that boosting selects for each target y."""
    _check(stepno, until)
    stats = feature_stats(long)
    shape = stats.agg(F.count("*").alias("p"), F.max("n").alias("n")).first()
    if (shape.p or 0) < 2:
        raise ValueError("boosting needs two features or more")
    if shape.p > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    targets = stats.select("feature_id")
    if until:
        targets = targets.orderBy("feature_id").limit(until)
    parts = max(1, min(shape.p // 16, long.sparkSession.sparkContext.defaultParallelism * 4))
    if fits(shape.p, shape.n) and 16 * shape.p**2 <= broadcast_bytes:
        sums = products(sample_rows(long), stats)
        if (sums.counts < sums.n).any():
            raise ValueError("a feature lacks samples that others have")
        shared = long.sparkSession.sparkContext.broadcast((sums.ids, sums.raw, sums.centred, sums.n))
        return targets.repartition(parts, "feature_id").mapInPandas(_products_kernel(shared, stepno), "y long, c long")
    vectors = materialise(to_vectors(long), "vectors")
    if shape.p * shape.n * 8 > broadcast_bytes:
        return _selections_by_blocks(vectors, targets, max(-(-shape.p // BLOCK), -(-shape.p * shape.n * 8 // BLOCK_BYTES)), stepno)
    rows = vectors.orderBy("feature_id").toPandas()  # at most broadcast_bytes, checked above
    data = np.array(list(rows["vec"]), float)
    shared = long.sparkSession.sparkContext.broadcast((rows["feature_id"].to_numpy(np.int64), data.tobytes(), data.shape[1]))
    return targets.repartition(parts, "feature_id").mapInPandas(_kernel(shared, stepno), "y long, c long")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("feature_id")
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["feature_id"].to_numpy(np.int64).tobytes()], "data": [np.array(list(pdf["vec"]), float).tobytes()], "n": [len(pdf["vec"].iloc[0])]})


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best candidate of a feature block for every target of a target block."""
    for pdf in batches:
        for r in pdf.itertuples():
            x = np.frombuffer(r.data, float).reshape(-1, r.n).T
            ids = np.frombuffer(r.ids, np.int64)
            own = np.frombuffer(r.t_ids, np.int64)
            xt, rt = np.frombuffer(r.t_data, float).reshape(-1, r.n).T, np.frombuffer(r.t_rest, float).reshape(-1, r.n).T
            nom = x.T @ xt - (x - x.mean(axis=0)).T @ rt
            nom[ids[:, None] == own[None, :]] = np.nan
            best = _select(nom, np.full(len(own), -1))
            ok = best >= 0
            yield pd.DataFrame({"y": own[ok], "c": ids[best[ok]], "nom": nom[best[ok], np.flatnonzero(ok)]})


def _selections_by_blocks(vectors: DataFrame, targets: DataFrame, blocks: int, stepno: int) -> DataFrame:
    """For matrices beyond a broadcast: each step, target blocks meet feature blocks over generated block numbers."""
    own = F.pmod(F.xxhash64("feature_id"), F.lit(blocks)).cast("int").alias("block")
    pack = "block int, ids binary, data binary, n long"
    features = materialise(vectors.select(own, "feature_id", "vec").groupBy("block").applyInPandas(_pack, pack), "feature-blocks")
    first = [r.feature_id for r in vectors.select("feature_id").orderBy("feature_id").limit(2).collect()]
    state = materialise(
        vectors.join(targets, "feature_id", "left_semi").select(
            F.col("feature_id").alias("y"), F.col("vec").alias("x"), F.transform("vec", lambda _: F.lit(0.0)).alias("rest"), F.when(F.col("feature_id") == first[0], first[1]).otherwise(first[0]).alias("last")
        ),
        "state",
    )
    chosen = []
    for _ in range(stepno):
        grouped = state.select(F.pmod(F.xxhash64("y"), F.lit(blocks)).cast("int").alias("t_block"), F.col("y"), "x", "rest").groupBy("t_block").applyInPandas(
            _pack_targets, "t_block int, t_ids binary, t_data binary, t_rest binary"
        )
        met = grouped.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(features, "block")
        best = met.mapInPandas(_best, "y long, c long, nom double")
        top = best.groupBy("y").agg(F.max_by(F.struct("c", "nom"), F.struct(F.col("nom") * F.col("nom"), -F.col("c"))).alias("b")).select("y", F.col("b.c").alias("c"), F.col("b.nom").alias("nom"))
        now = state.join(top, "y", "left").withColumn("c", F.coalesce("c", "last")).withColumn("nom", F.coalesce("nom", F.lit(0.0)))
        sel = vectors.select(F.col("feature_id").alias("c"), F.col("vec").alias("xs"))
        mean = F.aggregate("xs", F.lit(0.0), lambda a, v: a + v) / F.size("xs")
        now = now.join(sel, "c").withColumn("f", F.lit(NU) * F.col("nom") / (F.size("xs") - 1)).withColumn("m", mean)
        rest = F.expr("zip_with(rest, xs, (r, v) -> r + f * (v - m))")
        after = materialise(now.select("y", "x", rest.alias("rest"), F.col("c").alias("last")), "state")
        chosen.append(materialise(after.select("y", F.col("last").alias("c")), "chosen"))
        discard(state)
        state = after
    return reduce(DataFrame.unionByName, chosen).distinct()


def _pack_targets(pdf: pd.DataFrame) -> pd.DataFrame:
    flat = lambda c: np.array(list(pdf[c]), float).tobytes()
    return pd.DataFrame({"t_block": [int(pdf["t_block"].iloc[0])], "t_ids": [pdf["y"].to_numpy(np.int64).tobytes()], "t_data": [flat("x")], "t_rest": [flat("rest")]})


def edge_filter(long: DataFrame, stepno: int = 20, until: int = 0, **options) -> DataFrame:
    """(i, j), i < j, distinct: pairs of which either feature selected the other."""
    found = selections(long, stepno, until, **options)
    return found.select(F.least("y", "c").alias("i"), F.greatest("y", "c").alias("j")).distinct()


def selections_by_joins(long: DataFrame, stepno: int = 20) -> DataFrame:
    """The same by joins and aggregations alone: all inner products as a table. For few features, and as a check."""
    _check(stepno, 0)
    from weft.operators.scaling import center

    def products(df: DataFrame, name: str) -> DataFrame:
        a, b = df.select("sample_id", F.col("feature_id").alias("y"), F.col("value").alias("v")), df.select("sample_id", F.col("feature_id").alias("c"), F.col("value").alias("w"))
        return a.join(b, "sample_id").groupBy("y", "c").agg(F.sum(F.col("v") * F.col("w")).alias(name))

    n = long.agg(F.countDistinct("sample_id")).first()[0]
    cov = materialise(products(center(long), "zz").select("y", "c", (F.col("zz") / (n - 1)).alias("cov")), "cov")
    nom = materialise(products(long, "nom").where("y <> c"), "nom")
    chosen = []
    for step in range(stepno):
        top = materialise(nom.groupBy("y").agg(F.max_by(F.struct("c", "nom"), F.struct(F.col("nom") * F.col("nom"), -F.col("c"))).alias("b")).select("y", F.col("b.c").alias("sel"), (F.lit(NU) * F.col("b.nom")).alias("upd")), "top")
        chosen.append(top.select("y", F.col("sel").alias("c")))
        if step + 1 < stepno:
            stepped = nom.join(top, "y").join(cov.select(F.col("y").alias("sel"), "c", "cov"), ["sel", "c"])
            after = materialise(stepped.select("y", "c", (F.col("nom") - F.col("upd") * F.col("cov")).alias("nom")), "nom")
            discard(nom)
            nom = after
    return reduce(DataFrame.unionByName, chosen).distinct()
