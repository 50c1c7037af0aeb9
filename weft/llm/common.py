"""Shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.storage import materialise

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: A class of a larger share of all rows than one in so many is joined by a broadcast.
HOT_SHARE = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32(column as text) mod n; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def unused(columns: list[str], name: str) -> str:
    """A column name that is none of the columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def with_class(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of their class; ``size`` of classes says how many of ``total`` rows each has.

    Classes of at least a thousandth of all rows, a thousand at most, are
    broadcast; the others meet their rows by the key. Both tables are read
    more than once.
    """
    large = F.col("size") * HOT_SHARE >= max(1, total)
    hot, others = F.broadcast(classes.where(large).drop("size")), classes.where(~large).drop("size")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(others, key))


def same_id(rows: DataFrame) -> DataFrame:
    """(a, b): classes, by their digests, that an id of several of them connects, from rows (id, digest)."""
    h = F.xxhash64("digest")
    several = rows.groupBy("id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("id")
    own = materialise(rows.join(several, "id").select("id", "digest").distinct(), "several")
    return own.join(own.groupBy("id").agg(F.min("digest").alias("a")), "id").select("a", F.col("digest").alias("b")).where("a <> b")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8; bytes.split() has the same separators."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arithmetic wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return what this worker has freed to the system, so that idle workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def small_batches(batches: Iterator[pd.DataFrame], most: int = 256) -> Iterator[pd.DataFrame]:
    """Slices of at most so many rows, to bound what a Python worker builds at once."""
    for pdf in batches:
        for k in range(0, len(pdf), most):
            yield pdf.iloc[k : k + most]
    give_back()


def by_slices(of: Callable[[list[str | None]], list], kind: pa.DataType, most: int = 256) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """An Arrow UDF of texts that makes Python objects of a slice at a time and leaves its worker small."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array(of(texts.slice(k, most).to_pylist()), kind) for k in range(0, len(texts), most)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run
