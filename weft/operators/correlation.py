"""Pairwise moments, adjacency of edges, and the soft-threshold table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.products import feature_stats, fits, products, sample_rows
from weft.operators.scaling import center, ranked
from weft.sources.matrix import to_vectors

METHODS = ("pearson", "spearman", "kendall")
#: The powers that are tried for scale-free topology.
POWERS = (*range(1, 11), *range(12, 21))
#: Samples to a piece of a feature's vector.
PIECE = 4096


def pair_moments(long: DataFrame) -> DataFrame:
    """(i, j, gram, cov, corr) of all pairs of features i < j.

    Joined on the sample, so a task holds no more than its rows; products
    are summed map-side. For few features; for many use ``gram_blocks``.
    """
    a = long.select("sample_id", F.col("feature_id").alias("i"), F.col("value").alias("x"))
    b = long.select("sample_id", F.col("feature_id").alias("j"), F.col("value").alias("y"))
    return (
        a.join(b, "sample_id").where("i < j").groupBy("i", "j")
        .agg(F.sum(F.col("x") * F.col("y")).alias("gram"), F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("corr"))
    )


def _gram(p: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, one, n = np.zeros((p, p)), np.zeros(p), 0
        for pdf in batches:
            x = np.array(list(pdf["vec"]), float).reshape(-1, p)
            total += x.T @ x
            one += x.sum(axis=0)
            n += len(x)
        i, j = np.triu_indices(p)
        yield pd.DataFrame({"i": i + 1, "j": j + 1, "gram": total[i, j], "si": one[i], "sj": one[j], "n": n})

    return run


def gram_blocks(vectors: DataFrame, vec_col: str, p: int) -> DataFrame:
    """(i, j, gram, cov, corr) for i <= j over an array column of p features, one row a sample.

    Every task sums its own products (p x p numbers) before anything is
    shuffled; p is bounded by what a task may hold.
    """
    if p > 4096:
        raise ValueError("more features than a task may hold products of; use the edge-wise operators")
    parts = vectors.select(F.col(vec_col).cast("array<double>").alias("vec")).mapInPandas(_gram(p), "i long, j long, gram double, si double, sj double, n long")
    sums = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("gram", "si", "sj", "n")))
    cov = (F.col("gram") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)
    both = sums.select("i", "j", "gram", cov.alias("cov"))
    var = both.where("i = j").select("i", F.col("cov").alias("var"))
    sd = F.sqrt(F.col("vi") * F.col("vj"))
    return (
        both.join(var.select("i", F.col("var").alias("vi")), "i").join(var.select(F.col("i").alias("j"), F.col("var").alias("vj")), "j")
        .select("i", "j", "gram", "cov", (F.col("cov") / F.when(sd > 0, sd)).alias("corr"))
    )


def _inversions(ranks: np.ndarray) -> int:
    """Pairs k < l with ranks[k] > ranks[l]: bottom-up merging, one sort a level."""
    n, at, total, width = len(ranks), np.arange(len(ranks)), 0, 1
    while width < n:
        block, half = at // (2 * width), (at // width) & 1
        order = np.lexsort((half, ranks, block))
        left = half[order] == 0
        seen = np.cumsum(left)
        ends = np.searchsorted(block, block, side="right") - 1  # last place of each block
        rest = seen[ends] - seen  # left members of the same block that are larger
        total += int(rest[~left].sum())
        width *= 2
    return total


def _tied(*columns: np.ndarray) -> int:
    """Pairs that agree in all columns."""
    _, n = np.unique(np.stack(columns), axis=1, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b in n log^2 n."""
    n0 = len(x) * (len(x) - 1) // 2
    tx, ty, txy = _tied(x), _tied(y), _tied(x, y)
    order = np.lexsort((y, x))
    swaps = _inversions(np.unique(y, return_inverse=True)[1][order])
    bottom = float(n0 - tx) * float(n0 - ty)
    return (n0 - tx - ty + txy - 2 * swaps) / bottom**0.5 if bottom else float("nan")


def _pairwise(method: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                a, b = np.array(list(part["va"]), float), np.array(list(part["vb"]), float)
                if method == "kendall":
                    r = np.array([kendall(x, y) for x, y in zip(a, b, strict=True)])
                else:
                    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        r = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                yield pd.DataFrame({"i": part["i"], "j": part["j"], "corr": r})

    return run


def _looked_up(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, corr, lacking = shared.value
        for pdf in batches:
            i, j = pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64)
            a, b = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (i, j))
            ok = (ids[a] == i) & (ids[b] == j)
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            if lacking[a].any() or lacking[b].any():
                raise ValueError("a feature lacks samples that others have")
            yield pd.DataFrame({"i": i, "j": j, "corr": corr[a, b]})

    return run


def _piece_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = [(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(pdf["va"], pdf["vb"], strict=True)]
        sums = np.array([(a @ b, a @ a, b @ b) for a, b in pairs]).reshape(-1, 3)
        yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "ab": sums[:, 0], "aa": sums[:, 1], "bb": sums[:, 2]})


def _kendall_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = np.concatenate(list(pdf["va"])), np.concatenate(list(pdf["vb"]))
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "j": pdf["j"].iloc[:1], "corr": [kendall(a.astype(float), b.astype(float))]})


def _met(edges: DataFrame, vec: DataFrame, *by: str) -> DataFrame:
    return edges.select("i", "j").join(vec.select(F.col("feature_id").alias("i"), *by, F.col("vec").alias("va")), "i").join(
        vec.select(F.col("feature_id").alias("j"), *by, F.col("vec").alias("vb")), ["j", *by]
    )


def _by_pieces(edges: DataFrame, long: DataFrame, method: str, pieces: int) -> DataFrame:
    """Vectors meet piece by piece; a piece's samples are the same of every feature. An edge comes once."""
    edges = edges.select("i", "j").distinct()
    cut = long.withColumn("piece", F.pmod(F.xxhash64("sample_id"), F.lit(pieces)).cast("int"))
    if method == "kendall":  # needs both vectors of a pair in one place, but no more than one pair
        met = _met(edges, to_vectors(cut, "piece"), "piece").select("i", "j", "piece", "va", "vb")
        return met.groupBy("i", "j").applyInPandas(_kendall_pieces, "i long, j long, corr double")
    cut = center(long).withColumn("piece", F.pmod(F.xxhash64("sample_id"), F.lit(pieces)).cast("int"))
    sums = _met(edges, to_vectors(cut, "piece"), "piece").select("i", "j", "va", "vb").mapInPandas(_piece_sums, "i long, j long, ab double, aa double, bb double")
    total = sums.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("ab", "aa", "bb")))
    size = F.sqrt("aa") * F.sqrt("bb")
    return total.select("i", "j", (F.col("ab") / F.when(size > 0, size)).alias("corr"))


def edge_correlation(edges: DataFrame, long: DataFrame, method: str = "pearson") -> DataFrame:
    """(i, j, corr) of each edge.

    With more samples than features (MOST_FEATURES at most) it is looked up
    among the products of all features; otherwise vectors meet in two equi
    joins, in pieces of about PIECE samples.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    stats = feature_stats(long)
    shape = stats.agg(F.count("*").alias("p"), F.max("n").alias("n")).first()
    if method == "spearman":
        long = ranked(long)
    if method != "kendall" and fits(shape.p, shape.n):
        sums = products(sample_rows(long), feature_stats(long) if method == "spearman" else stats)
        shared = long.sparkSession.sparkContext.broadcast((sums.ids, sums.correlations(), sums.counts < sums.n))
        return edges.select("i", "j").mapInPandas(_looked_up(shared), "i long, j long, corr double")
    pieces = -(-(shape.n or 0) // PIECE)
    if pieces > 1:
        return _by_pieces(edges, long, method, pieces)
    return _met(edges, to_vectors(long)).select("i", "j", "va", "vb").mapInPandas(_pairwise(method), "i long, j long, corr double")


def adjacency(edges: DataFrame, long: DataFrame, soft_power: float = 2, method: str = "pearson") -> DataFrame:
    """(i, j, adj): |correlation| to the soft power."""
    return edge_correlation(edges, long, method).select("i", "j", F.pow(F.abs("corr"), F.lit(float(soft_power))).alias("adj"))


def soft_power_table(corr: DataFrame, powers=POWERS, bins: int = 10) -> DataFrame:
    """(power, r2, slope, signed_r2, mean_k) of the scale-free fit, from (i, j, corr) of all pairs i < j.

    A node's connectivity is the sum of |corr|^power over the others; nodes
    fall into equal-width bins, and log10 of the share of nodes is regressed
    on log10 of the mean connectivity over the bins that have nodes.
    """
    both = corr.select("i", "corr").unionAll(corr.select(F.col("j"), F.col("corr")))
    power = F.explode(F.array(*map(F.lit, powers))).alias("power")
    k = both.select("i", F.abs("corr").alias("r"), power).groupBy("power", "i").agg(F.sum(F.pow("r", F.col("power").cast("double"))).alias("k"))
    edge = k.groupBy("power").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"), F.avg("k").alias("mean_k"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("k") - F.col("lo")) / F.when(width > 0, width))).alias("bin")
    binned = k.join(F.broadcast(edge), "power").select("power", "k", "n", "mean_k", F.coalesce(bin_, F.lit(0)).alias("bin"))
    points = binned.groupBy("power", "bin").agg(
        F.log10(F.avg("k")).alias("x"), F.log10(F.count("*") / F.max("n")).alias("y"), F.max("mean_k").alias("mean_k")
    )
    return points.groupBy("power").agg(
        F.regr_r2("y", "x").alias("r2"), F.regr_slope("y", "x").alias("slope"), (-F.signum(F.regr_slope("y", "x")) * F.regr_r2("y", "x")).alias("signed_r2"), F.max("mean_k").alias("mean_k")
    )


def pick_soft_power(corr: DataFrame, least: float = 0.85, powers=POWERS) -> int:
    """The first power whose signed fit is above ``least``; ValueError if none is."""
    found = soft_power_table(corr, powers).where(F.col("signed_r2") > least).agg(F.min("power")).first()[0]
    if found is None:
        raise ValueError("no soft power reaches the scale-free fit; pass one")
    return int(found)
