"""Toxicity classifier with counterfactual regularisation.

Logistic regression over the presence of words, word beginnings, and beginnings
that several words share. Labelled
sentences with an identity term are paired with copies that name another
group of the same kind, or none, instead, and training penalises the squared change of the score between
the two, so that neutral mentions of a group don't raise it. Presence, not
frequency, so that a long text doesn't dilute what it contains.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import by_slices, give_back, remainder, small_batches
from weft.llm.quality import SAMPLE_BYTES, labelled

#: The most labelled rows that are learned from, and the most features kept, those that tell most.
SAMPLE, FEATURES = 8000, 4000
BEGINNINGS = (3, 4, 5, 6)
#: Terms for groups of people; those of one line, of one kind and language, stand for one another in swapped sentences.
IDENTITY = """
women men girls boys
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
gay lesbian bisexual transgender straight queer
black white asian african latino arab
immigrant refugee foreigner
immigrants refugees foreigners
disabled deaf blind
elderly young old
poor rich
frauen männer
muslime christen juden
ausländer flüchtlinge einwanderer
femmes hommes
musulmans chrétiens juifs
étrangers réfugiés immigrés
mujeres hombres
musulmanes cristianos judíos
extranjeros refugiados inmigrantes
"""


def kinds_of(identity: str = IDENTITY) -> dict[str, list[str]]:
    """The terms that may stand for each term, itself among them."""
    return {w: line.split() for line in identity.split("\n") for w in line.split()}


_words = re.compile(r"\w+").findall


def features(words: set[str]) -> set[str]:
    """Words, beginnings ("abcd-"), and beginnings of two words or more ("abcd--")."""
    out = set(words)
    for n in BEGINNINGS:
        for p, k in Counter(w[:n] for w in words if len(w) >= n).items():
            out.add(p + "-")
            if k > 1:
                out.add(p + "--")
    return out


def words_of(text: str | None) -> set[str]:
    return set(_words(text.lower())) if text else set()


def _matrix(bags: list[set[str]], index: dict[str, int]) -> list[np.ndarray]:
    return [np.array(sorted(index[f] for f in features(b) if f in index), np.int64) for b in bags]


def train(
    texts: list[str | None], y: np.ndarray, identity: str = IDENTITY, penalty: float = 2.0, epochs: int = 12, rate: float = 0.3, shrink: float = 1.2e-3, seed: int = 11, most_features: int = FEATURES
) -> tuple[dict[str, float], float]:
    """Weights of the ``most_features`` features that tell most, and the bias."""
    rng = np.random.default_rng(seed)
    bags = lambda: map(words_of, texts)  # noqa: E731  made anew in each pass, so that no more than one is held
    others, groups = kinds_of(identity), set()
    seen = np.zeros(1 << 22, np.uint8)  # a first count by hash, at least the true one, so that rare features take no memory
    for b in bags():
        groups |= b & others.keys()
        at = np.fromiter(map(hash, features(b)), np.int64) & (len(seen) - 1)
        seen[at] = np.minimum(seen[at] + 1, 100)
    kind = [Counter(), Counter()]
    for b, k in zip(bags(), y, strict=True):
        kind[k].update(f for f in features(b) if seen[hash(f) & (len(seen) - 1)] >= 3)
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())

    def gains() -> Iterator[tuple[float, str]]:
        for f in kind[0].keys() | kind[1].keys():
            a, b = kind[1][f], kind[0][f]
            if a + b >= 3:
                p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
                yield -abs(p - q) * abs(np.log(p / q)), f

    kept = [f for _, f in nsmallest(most_features, gains())]
    index = {f: i for i, f in enumerate(dict.fromkeys([*kept, *(g for w in sorted(groups) for g in sorted(features({w})))]))}
    del kind
    rows: list[np.ndarray] = []
    twins: dict[int, np.ndarray] = {}
    for i, b in enumerate(bags()):
        rows += _matrix([b], index)
        if own := b & groups:
            swapped = b - own
            for g in sorted(own):  # half of the time for a placeholder without weight, as terms of a kind may be alike in their weights
                k = int(rng.integers(2 * len(others[g])))
                if k < len(others[g]):
                    swapped.add(others[g][k])
            twins[i] = _matrix([swapped], index)[0]
    w, bias = np.zeros(len(index)), float(np.log((n1 + 1) / (n0 + 1)))
    weight = {1: 0.5 * (n0 + n1) / max(1, n1), 0: 0.5 * (n0 + n1) / max(1, n0)}
    steps, total = 0, epochs * max(1, len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, lr = rows[i], rate * (1 - steps / total)
            steps += 1
            g = weight[int(y[i])] ** 0.9 * (1 / (1 + np.exp(-np.clip(bias + w[x].sum(), -40, 40))) - y[i])
            w[x] -= lr * g
            bias -= lr * 0.1 * g
            if i in twins:
                t = twins[i]
                gap = w[x].sum() - w[t].sum()
                step = lr * penalty * 2 * gap / (len(x) + len(t) + 1)
                w[x] -= step
                w[t] += step
            w[x] = np.sign(w[x]) * np.maximum(np.abs(w[x]) - lr * shrink, 0)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * 20, 0)
    return {f: float(w[i]) for f, i in index.items() if w[i]}, bias


class Model:
    """Weights by kind of feature, ready to score."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.whole = {f: w for f, w in weights.items() if not f.endswith("-")}
        # Beginnings by length: the weight of one word, and of two or more.
        self.begin: dict[int, dict[str, tuple[float, float]]] = {n: {} for n in BEGINNINGS}
        for p in {f.rstrip("-") for f in weights if f.endswith("-")}:
            one = weights.get(p + "-", 0.0)
            self.begin[len(p)][p] = (one, one + weights.get(p + "--", 0.0))

    def scores(self, texts) -> np.ndarray:
        out = []
        for text in texts:
            words = words_of(text)
            z = self.bias + sum(map(self.whole.__getitem__, sorted(self.whole.keys() & words)))
            for n, known in self.begin.items():
                starts = Counter([w[:n] for w in words])
                for p in sorted(known.keys() & starts.keys()):
                    z += known[p][starts[p] > 1]
            out.append(z)
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -40, 40)))


def _scorer(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*model.value)
        for pdf in small_batches(batches):
            yield pd.DataFrame({"id": pd.array(pdf["id"], "Int64"), "held_out": pdf["held"].to_numpy(bool), "score": own.scores(pdf["text"])})

    return run


def _text_scorer(model):
    held: list[Model] = []  # unpacked once a worker's task

    def scores(texts: list[str | None]) -> list[float]:
        if not held:
            held.append(Model(*model.value))
        return held[0].scores(texts).tolist()

    return by_slices(scores, pa.float64())


def fitted(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic", folds: int = 3, held_fold: int = 1, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, most_features: int = FEATURES
):
    """A broadcast model learned from a bounded sample of labelled rows outside the held-out fold; see labelled."""
    known = labelled(docs, labels, id_col, text_col, label_col, folds, held_fold, sample, sample_bytes)
    texts, y = known["text"].tolist(), known["y"].to_numpy(int)
    del known
    model = docs.sparkSession.sparkContext.broadcast(train(texts, y, most_features=most_features))
    del texts
    give_back()
    return model


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1, threshold: float = 0.7, **bounds: int
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    Learns from at most ``sample`` labelled rows outside the held-out fold, at
    most ``sample_bytes`` of their texts and ``most_features`` features (the
    bounds, see fitted), from the texts alone; an id with several labels or
    texts counts with the smallest. Null and empty texts get the bias's score;
    texts of any length are scored whole; null ids stay null and count as ""
    in the fold; repeated rows get equal scores; without labelled rows the
    score is 0.5; an empty table gives an empty result; other columns are
    ignored.
    """
    model = fitted(docs, labels, id_col, text_col, label_col, folds, held_fold, **bounds)
    plain = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), (remainder(id_col, folds) == held_fold).alias("held")
    )
    scored = plain.mapInPandas(_scorer(model), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """Rows of docs, with all their columns, whose score is below the threshold.

    Scored row by row where they are, so nothing is joined back: rows with null
    or empty texts have the bias's score, rows with equal texts stay or go
    together, null ids stay as they are, columns may have any names, an empty
    table gives an empty one. options: those of fitted.
    """
    model = fitted(docs, labels, id_col, text_col, **options)
    score = F.arrow_udf(_text_scorer(model), "double")
    return docs.where(score(F.col(f"`{text_col}`").cast("string")) < threshold)
