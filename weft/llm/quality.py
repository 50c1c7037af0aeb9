"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its words, its character
n-grams and the pattern "a word repeats the one before it", each hashed to a
bucket; softmax over the average gives the score. Trained by numpy stochastic
gradient descent. At scoring time the output layer is folded into the vectors,
so each bucket costs one gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import remainder, small_batches
from weft.storage import discard, materialise

#: Buckets of words and of character n-grams, length of a vector, n-gram lengths in bytes.
WORD_BUCKETS, GRAM_BUCKETS, DIM, GRAMS = 1 << 16, 1 << 17, 8, (3, 4)
BUCKETS = WORD_BUCKETS + GRAM_BUCKETS + 2
#: The most labelled rows that are learned from, chosen by a hash of their id.
SAMPLE = 4000
#: The most bytes of their texts; the first text in that order that would go beyond ends the sample.
SAMPLE_BYTES = 64 << 20


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every word, n-gram and pattern of the text; never empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    tokens = data.split()
    h = np.fromiter(map(xxhash.xxh32_intdigest, tokens), np.uint32, len(tokens))
    parts = [(h & np.uint32(WORD_BUCKETS - 1)).astype(np.int64)]
    parts.append(np.full(int((h[1:] == h[:-1]).sum()) * 4, WORD_BUCKETS + GRAM_BUCKETS, np.int64))
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    for n in GRAMS:
        if len(raw) >= n:
            g = np.full(len(raw) - n + 1, n, np.uint32)
            for k in range(n):
                g = g * np.uint32(0x01000193) + raw[k : len(raw) - n + 1 + k]
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            parts.append(WORD_BUCKETS + (g >> np.uint32(15)).astype(np.int64))
    parts.append(np.array([BUCKETS - 1]))
    return np.concatenate(parts)


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Score of each bucket and the bias: sigmoid(mean of the buckets' scores + bias)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = []
    for t in texts:
        ids, n = np.unique(buckets(t), return_counts=True)
        bags.append((ids.astype(np.int32), (n / n.sum()).astype(np.float32)))
    steps, total = 0, epochs * max(1, len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            lr = rate * (1 - steps / total)
            steps += 1
            rows = vectors[ids]
            x = share @ rows
            z = out @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out.T @ p
            out -= lr * np.outer(p, x)
            bias -= lr * 0.1 * p
            # A feature's step is its share of the text, as many times as the text has distinct ones.
            vectors[ids] = rows - lr * min(len(ids), 50) * share[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _scorer(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, bias = model.value
        for pdf in small_batches(batches):
            z = np.array([weight[buckets(t)].mean() for t in pdf["text"]], float) + bias
            yield pd.DataFrame({"id": pd.array(pdf["id"], "Int64"), "held_out": pdf["held"].to_numpy(bool), "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))})

    return run


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_fold: int, sample: int, sample_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """Labelled rows (id, text, y) outside the held-out fold, in order of a hash of their id, up to ``sample`` rows and ``sample_bytes`` of text.

    An id with several labels has the smallest, one with several texts the
    smallest of these; other labels than 0 and 1 don't count.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1) and id is not null")
    known = known.where(remainder("id", folds) != held_fold).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = plain.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    table = materialise(found.select("id", "text", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("id").alias("h")), "sample")
    order = sorted(table.select("h", "id", "size").collect())  # at most `sample` rows
    ends = np.cumsum([r["size"] for r in order])
    chosen = [r.id for r, end in zip(order, ends, strict=True) if end <= sample_bytes]
    rows = table.where(F.col("id").isin(chosen)) if len(chosen) < len(order) else table
    got = rows.select("id", "text", "y").toPandas().sort_values("id", ignore_index=True)
    discard(table)
    return got


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, threshold: float = 0.3, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    Learns from at most ``sample`` labelled rows outside the held-out fold and
    at most ``sample_bytes`` of their texts (see labelled), from the texts
    alone; an id with several labels or texts counts with the smallest. Null
    and empty texts get the score of a text without words; texts of any length
    are scored whole; null ids stay null and count as "" in the fold; repeated
    rows get equal scores; without labelled rows (or with labels of one kind)
    the score is 0.5 or that kind's side; an empty table gives an empty
    result; other columns are ignored.
    """
    known = labelled(docs, labels, id_col, text_col, label_col, folds, held_fold, sample, sample_bytes)
    model = docs.sparkSession.sparkContext.broadcast(train(list(known["text"]), known["y"].to_numpy(int)))
    plain = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), (remainder(id_col, folds) == held_fold).alias("held")
    )
    scored = plain.mapInPandas(_scorer(model), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
