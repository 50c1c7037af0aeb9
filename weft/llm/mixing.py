"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a keyed hash, which is their
random permutation. A source whose target is r times its size is passed over
floor(r) times whole, and once more up to a cut in the permuted order, so its
taken words come within one document of the target. The quota of block copies
of every source is then split exactly among output shards: a binary tree over
the shards draws, at each node, how many of each source's blocks go left from
a multivariate hypergeometric distribution. A block copy's rank in its
source's order and the leaf quotas give its shard; inside a shard rows are
shuffled by another keyed hash.

Only the table of sources (one row each) and its quotas are ever on the
driver; documents are handled by DataFrame functions alone, and their texts
are read once to be measured and once more only if the mixture itself is made.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.storage import materialise

#: Sources by code point, null last, weigh these, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Words of a source to a block.
BLOCK_WORDS = 1 << 16
SHARDS = 64
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: shares of ``share`` of all sizes by weight, none above ``most`` times its size.

    A source that would be above stops there and the excess is reshared among
    the others by weight, until none is above.
    """
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    total, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while free:
        each = sum(w[k] for k in free)
        full = {k for k in free if left * w[k] / each > most * sizes[k]}
        if not full:
            for k in free:
                out[k] = left * w[k] / each
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        free -= full
        left = max(left, 0.0)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source go to each shard, exact in both sums.

    Recursive: a node's blocks are divided among its halves in proportion to
    their shards, and the left half's share of each source is drawn from the
    multivariate hypergeometric distribution.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid, n = (lo + hi) // 2, int(q.sum())
        take = n * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if n else q
        split(left, lo, mid)
        split(q - left, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _literal(spark, rows: list[dict], schema: str) -> DataFrame:
    """A table of constants, without Python on the executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _at_source(df: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """df with the columns of its source."""
    return df.join(F.broadcast(table) if n <= BROADCAST_SOURCES else table, F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")


def _coprime(n: int, seed: int) -> int:
    """A stride below n without a common divisor, so that its multiples permute 0..n-1."""
    rng = np.random.default_rng(seed)
    return next((int(x) for x in rng.integers(1, n, 1000) if math.gcd(int(x), n) == 1), 1) if n > 2 else 1


def _row_hash(id_col: str, text_col: str, seed: int) -> Column:
    """A row's place in the permutation of its source; rows with equal ids and texts share it."""
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _with_block(df: DataFrame) -> DataFrame:
    return df.withColumn("u", F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))).withColumn(
        "block", F.least(F.floor(F.col("u") * F.col("blocks")), F.col("blocks") - 1)
    )


def _running(order: str) -> Column:
    return F.expr(f"sum(words) over (partition by source order by {order} rows between unbounded preceding and current row)")


def decide(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = 17) -> tuple[DataFrame, int]:
    """The table of sources with targets, cuts and shard quotas, and its number of rows; sized has (source, size, h)."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row a source
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.size) for r in found]
    rows = []
    for r, s, t in zip(found, sizes, targets(sizes, weights, share, most), strict=True):
        p = min(math.floor(most), math.floor(t / s + 1e-12)) if s else 0
        rows.append({"s_source": r.source, "source_size": s, "target": t, "blocks": max(1, -(-s // BLOCK_WORDS)), "passes": p, "rest": max(0.0, t - p * s)})
    n = len(rows)
    schema = "s_source:string,source_size:bigint,target:double,blocks:bigint,passes:bigint,rest:double"
    placed = _with_block(_at_source(sized.where("size > 0"), _literal(spark, rows, schema), n))

    # The block of each source in which the running sum of the last pass crosses what is left to take.
    each = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    cut = each.withColumn("upto", _running("block")).where("rest > 0 and upto > rest and upto - words <= rest")
    cut = cut.select(F.col("source").alias("s_source"), F.col("block").alias("c_block"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    crossing = [r.asDict() for r in cut.collect()]  # at most one row a source
    # In that block, the hash at which the running sum comes nearest.
    inside = _at_source(placed, _literal(spark, crossing, "s_source:string,c_block:bigint,left:double"), n).where("block = c_block")
    same = inside.groupBy("source", "u", "h").agg(F.sum("size").alias("words"), F.count("*").alias("copies"), F.first("left").alias("left"))
    some = F.round((F.col("left") - F.col("upto") + F.col("words")) / F.col("words") * F.col("copies")).cast("long")
    at_hash = same.withColumn("upto", _running("u, h")).where("upto > left and upto - words <= left").select("source", "u", "h", "copies", some.alias("some"))
    nearest = {r.source: r for r in at_hash.collect()}  # at most one row a source
    first = {r["s_source"]: r["c_block"] for r in crossing}
    for r in rows:
        name, c = r["s_source"], nearest.get(r["s_source"])
        r["c_block"] = first.get(name, r["blocks"] if r["rest"] > 0 else 0)
        r["c_u"], r["c_h"], r["copies"], r["some"] = (c.u, c.h, c.copies, c.some) if c else (-1.0, 0, 1, 0)
    quotas = np.array([r["blocks"] * r["passes"] + min(r["blocks"], r["c_block"] + (r["s_source"] in first)) for r in rows], np.int64)
    leaves = split_quotas(quotas, shards, seed) if n else np.zeros((shards, 0), np.int64)
    for k, r in enumerate(rows):
        r["leaf"], r["quota"], r["stride"] = np.cumsum(leaves[:, k]).tolist(), max(1, int(quotas[k])), _coprime(int(quotas[k]), seed + k)
    more = ",c_block:bigint,c_u:double,c_h:bigint,copies:bigint,some:bigint,leaf:array<bigint>,quota:bigint,stride:bigint"
    return _literal(spark, rows, schema + more), n


def _taken(df: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """df (source, h, row, ...) with the columns of its source, times, and the shards of the row's copies."""
    placed = _with_block(_at_source(df, table, n))
    at_cut = (F.col("u") == F.col("c_u")) & (F.col("h") == F.col("c_h"))
    before = (F.col("u") < F.col("c_u")) | ((F.col("u") == F.col("c_u")) & (F.col("h") < F.col("c_h")))
    tied = at_cut & (F.col("some") > F.when(F.col("copies") > 1, F.pmod(F.xxhash64("row"), F.col("copies"))).otherwise(0))
    extra = (F.col("block") < F.col("c_block")) | ((F.col("block") == F.col("c_block")) & (before | tied))
    placed = placed.withColumn("times", (F.col("passes") + F.when(extra, 1).otherwise(0)).cast("int"))
    # Copy c of a block is number c * blocks + block of its source; a stride permutes the numbers.
    copies = F.expr("if(times > 0, transform(sequence(0L, times - 1L), c -> pmod((c * blocks + block) * stride, quota)), array())")
    return placed.withColumn("shards", F.transform(copies, lambda k: F.size(F.filter("leaf", lambda x: x <= k))))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """(id, size, source_size, target, taken, shards) for every row of docs.

    size: words of the text, however long (null: 0). taken: words the mixture
    takes, size times the row's copies; shards: where its copies go. Rows that
    tie at the cut of a source (equal ids and texts) are taken as often as the
    target leaves room for, by a hash of the row. Null sources are one
    source, sorted last; null ids stay null; repeated rows are rows of their
    own; a source without words has target 0; an empty table gives an empty
    result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            _row_hash(id_col, text_col, seed).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sized",
    )
    table, n = decide(sized, seed=seed, **options)
    return _taken(sized, table, n).select("id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mixture itself: rows of docs as often as they are taken, dealt to shards and shuffled inside them.

    Has the columns of docs alone, whatever they are called. Texts are read
    twice, to be measured and to be dealt out. See plan() for nulls, ties,
    repeats and empty tables; rows without words are taken as often as their
    source.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = _row_hash(id_col, text_col, seed)
    sized = materialise(docs.select(F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h.alias("h")), "sized")
    table, n = decide(sized, seed=seed, **options)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(source_col).cast("string").alias("source"), h.alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = _taken(rows, table, n).select("doc", "h", "row", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed + 1), "h", "copy")
    return dealt.repartition("shard", F.pmod(order, F.lit(8))).sortWithinPartitions("shard", order).select("doc.*")
