"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Each vector is hashed by the signs of its products with random hyperplanes,
in TABLES tables of BITS signs. Vectors that share a table's key are compared
by exact cosine in double precision. At a cosine of 0.98 a pair agrees on one
sign with probability 1 - acos(0.98)/pi = 0.936, so it shares at least one of
the 28 keys of 18 signs with probability 0.99996.

Hot groups: equal vectors collapse to one class before hashing. A bucket of
many classes is cut into blocks by a hash of the class, and every pair of
blocks is a unit of work of its own, so no task holds a whole bucket. A unit
counts links and returns at most one row for each of its members (its number
of new links, and the least member of its part of the graph), never pairs. A
pair that shares several keys is counted in the first table that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import MIX, same_id, scramble, small_batches, with_class
from weft.operators.components import connected_components
from weft.storage import discard, materialise

TABLES, BITS = 28, 18
#: Classes in a block of a bucket.
BLOCK = 256


@lru_cache(8)
def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, TABLES * BITS))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; first by their largest component, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES) table keys, without table and label."""
    signs = (x @ planes(x.shape[1]) > 0).reshape(len(x), TABLES, BITS)
    return signs.astype(np.int64) @ (1 << np.arange(BITS, dtype=np.int64))


def _hashed(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small_batches(batches, 1024):
            vec, digest, dim = [None] * len(pdf), [None] * len(pdf), np.zeros(len(pdf), np.int64)
            of_dim: dict[int, list[int]] = {}
            for k, (i, label, v) in enumerate(zip(pdf["id"], pdf["label"], pdf["vec"], strict=True)):
                if v is None or not len(v) or pd.isna(i) or pd.isna(label):
                    continue
                try:
                    x = np.asarray(v, np.float64)  # a null component is no number
                except (TypeError, ValueError):
                    continue
                if np.isfinite(x).all() and x.any():
                    x = x + 0.0  # -0.0 is 0.0
                    vec[k], dim[k] = x.astype(kind).tobytes(), len(x)
                    digest[k] = xxhash.xxh3_128_digest(vec[k] + int(label).to_bytes(8, "little", signed=True))
                    of_dim.setdefault(len(x), []).append(k)
            found = [None] * len(pdf)
            for n, rows in of_dim.items():
                x = np.frombuffer(b"".join(vec[k] for k in rows), kind).astype(np.float64).reshape(-1, n)
                h = keys(unit(x)).astype(np.uint64)
                label = pdf["label"].to_numpy()[rows].astype(np.int64).astype(np.uint64)
                h = scramble(scramble(h * MIX + np.arange(1, TABLES + 1, dtype=np.uint64)) + label[:, None] * MIX + np.uint64(n))
                for k, own in zip(rows, h.view(np.int64), strict=True):
                    found[k] = own
            yield pd.DataFrame({"id": pd.array(pdf["id"], "Int64"), "label": pd.array(pdf["label"], "Int64"), "dim": dim, "vec": vec, "digest": digest, "keys": found})

    return run


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n members reaches over edges a-b."""
    least = np.arange(n)
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        now = now[now]
        if (now == least).all():
            return now
        least = now


class _Rows:
    """A batch of unit rows as arrays, their directions and keys computed once."""

    def __init__(self, pdf: pd.DataFrame, kind: str):
        self.cols = {c: pdf[c].to_numpy() for c in ("key", "b1", "b2", "at", "block", "digest", "rep", "label", "dim", "size")}
        self.x: dict[int, np.ndarray] = {}
        self.h: dict[int, np.ndarray] = {}
        self.at = np.zeros(len(pdf), np.int64)
        vec = pdf["vec"].to_numpy()
        for dim in np.unique(self.cols["dim"]):
            rows = np.flatnonzero(self.cols["dim"] == dim)
            self.at[rows] = np.arange(len(rows))
            x = unit(np.frombuffer(b"".join(vec[rows]), kind).astype(np.float64).reshape(len(rows), -1))
            self.x[int(dim)], self.h[int(dim)] = x, keys(x)

    def cuts(self) -> list[int]:
        key, b1, b2 = (self.cols[c] for c in ("key", "b1", "b2"))
        return [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(b1) != 0) | (np.diff(b2) != 0)) + 1).tolist(), len(key)]

    def linked(self, start: int, end: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows of a unit that gain links: which, how many new ones, and the least member they reach."""
        rows = np.arange(start, end)
        if len(rows) < 2:
            return None
        c = self.cols
        rows = rows[(c["label"][rows] == c["label"][start]) & (c["dim"][rows] == c["dim"][start])]  # else keys collide by chance
        rows = rows[np.argsort(c["rep"][rows], kind="stable")]
        dim, at = int(c["dim"][start]), self.at[rows]
        x = self.x[dim][at]
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        if c["b1"][start] != c["b2"][start]:
            across = c["block"][rows[a]] != c["block"][rows[b]]
            a, b = a[across], b[across]
        table = int(c["at"][start])
        if len(a) and table:
            h = self.h[dim][at, :table]
            new = ~(h[a] == h[b]).any(axis=1)
            a, b = a[new], b[new]
        if not len(a):
            return None
        size, links = c["size"][rows], np.zeros(len(rows), np.int64)
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        root = c["rep"][rows][_components(len(rows), a, b)]
        got = links > 0
        return rows[got], links[got], root[got]


def _units(kind: str, least: float):
    """Rows sorted by unit; a unit may span batches."""

    def found(rows: _Rows, cuts: list[int]) -> Iterator[pd.DataFrame]:
        out = [got for s, e in pairwise(cuts) if (got := rows.linked(s, e, least)) is not None]
        if out:
            at, links, root = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"digest": rows.cols["digest"][at], "rep": rows.cols["rep"][at], "root": root, "links": links})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if len(pdf):
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                rows = _Rows(pdf, kind)
                cuts = rows.cuts()
                held = pdf.iloc[cuts[-2] :]
                yield from found(rows, cuts[:-1])
        if held is not None:
            rows = _Rows(held, kind)
            yield from found(rows, rows.cuts())

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of vectors.

    Two vectors are linked when their labels are equal and not null and their
    cosine is at least ``cosine``. n_links counts other rows linked directly,
    component_id is the smallest id reachable, kept is id = component_id.
    Linked with nothing: vectors that are null, empty, zero or hold null or
    non-finite components, null labels, null ids (their component is null,
    kept true) and vectors of another length. Rows that repeat an id count
    each as a vector and share a component, whatever their vectors; vectors
    of any length are compared whole; an empty table gives an empty result;
    other columns are ignored.
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.jsonValue().get("elementType") == "float" else "<f8"
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    hashed = materialise(plain.mapInPandas(_hashed(kind), "id long, label long, dim long, vec binary, digest binary, keys array<long>"), "vectors")
    classes = materialise(
        hashed.where("digest is not null").groupBy("digest").agg(
            F.min("id").alias("rep"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in ("label", "dim", "vec", "keys"))
        ),
        "classes",
    )
    banded = materialise(classes.select("digest", "rep", F.posexplode("keys").alias("at", "key")), "banded")
    full = materialise(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "full")  # written, so that a large bucket's join can be split
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    inside = banded.join(full, "key").withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(digest), blocks) as int)"))
    inside = inside.join(classes.select("digest", "label", "dim", "size", "vec"), "digest")
    dealt = inside.select(
        "*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    ).select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "at", "block", "digest", "rep", "label", "dim", "size", "vec")
    # Rows of one unit stay together; a bucket's units spread by their blocks.
    sent = dealt.repartition(F.col("key"), F.col("b1"), F.col("b2")).sortWithinPartitions("key", "b1", "b2")
    found = materialise(sent.mapInPandas(_units(kind, cosine), "digest binary, rep long, root long, links long"), "found")
    named = hashed.where("digest is not null").select("id", "digest")
    r = lambda a, b: classes.select(F.col("digest").alias(a), F.col("rep").alias(b))
    again = same_id(named).join(r("a", "i"), "a").join(r("b", "j"), "b").select("i", "j")
    near = connected_components(found.select(F.col("root").alias("i"), F.col("rep").alias("j")).unionByName(again).where("i <> j"))
    linked = found.groupBy("digest").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("digest", "rep", "size")
        .join(linked, "digest", "left")
        .join(near.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", "size", F.coalesce("component", "rep").alias("comp"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("links"))
    )
    of_class = materialise(of_class, "named")
    for t in (banded, found, near):
        discard(t)
    alone = hashed.where("digest is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("comp"))
    every = with_class(named, of_class, "digest", hashed.count()).select("id", "links", "comp").unionByName(alone)
    return every.select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept")
    )
