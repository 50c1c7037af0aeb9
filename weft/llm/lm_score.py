"""Language-model scores from a log-frequency Bloom filter.

Bigram counts of the training rows are quantised to levels on a logarithmic
scale; an n-gram of level q is inserted with 1..q, so its level is found by
probing (n-gram, 1), (n-gram, 2), ... until one is absent (Talbot and
Osborne's log-frequency Bloom filter). The filter is built in segments of
bounded size, one per group of n-gram hashes, and broadcast to the workers
while its measured size is below ``broadcast_bytes``; beyond that the probes
travel to the segments instead, with the same results. Unigram counts are
exact: each chunk of documents sends the hashes of its distinct words to the
segments and gets their counts back, so neither the vocabulary nor its counts
ever meet in one place.

Probability: p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu) with c(v w) the
quantised count (levels round down, so the sum over w stays at most one but
for false positives) and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). A text is
its words and one end token, after a start context.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import MIX, give_back, hashes, remainder, scramble, words
from weft.storage import materialise

END, START = np.uint64(xxhash.xxh3_64_intdigest(b"")), np.uint64(0x5EED)
BITS_PER_ENTRY, PROBES = 14, 10
#: Tokens of the corpus to a segment; bounds what one group holds.
SEGMENT_TOKENS = 2_000_000
#: Bytes of text whose documents are handled together.
CHUNK_BYTES = 8 << 20
MU = 32.0


def thresholds() -> np.ndarray:
    """The smallest count of each level: 1, 2, 3, 4, 6, 9, ..., a factor of 1.5 apart."""
    t = [1]
    while t[-1] < 2**50:
        t.append(max(t[-1] + 1, t[-1] * 3 // 2))
    return np.array(t, np.int64)


LEVELS = thresholds()


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def _positions(seg: np.ndarray, fp: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    x = scramble(fp.astype(np.uint64) + (np.uint64(level) << np.uint64(32)) + seg.astype(np.uint64) * MIX)
    return x >> np.uint64(20), (scramble(x) >> np.uint64(20)) | np.uint64(1)


class Filter:
    """Segments of a log-frequency Bloom filter, side by side."""

    def __init__(self, parts: list[tuple[int, int, int]], data: bytes | bytearray, segments: int):
        """parts: (segment, its bits, its bytes), in the order of data; data isn't copied."""
        self.bits, self.start = np.zeros(segments, np.uint64), np.zeros(segments, np.uint64)
        at = 0
        for seg, bits, size in parts:
            self.bits[seg], self.start[seg] = bits, at
            at += size * 8
        self.data = np.frombuffer(data, np.uint8)

    @staticmethod
    def build(seg: int, fp: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
        level = np.searchsorted(LEVELS, counts, side="right")
        bits = max(64, int(level.sum()) * BITS_PER_ENTRY)
        data = np.zeros(-(-bits // 8) * 8, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            own = fp[level >= q]
            h, step = _positions(np.full(len(own), seg), own, q)
            for k in range(PROBES):
                data[(h + np.uint64(k) * step) % np.uint64(bits)] = True
        return seg, bits, np.packbits(data, bitorder="little").tobytes()

    def levels(self, seg: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if absent; repeated membership probes."""
        out = np.zeros(len(fp), np.uint8)
        alive = np.flatnonzero(self.bits[seg] > 0)
        q = 0
        while len(alive):
            q += 1
            h, step = _positions(seg[alive], fp[alive], q)
            there, bits, start = np.arange(len(alive)), self.bits[seg[alive]], self.start[seg[alive]]
            for k in range(PROBES):
                p = start[there] + (h[there] + np.uint64(k) * step[there]) % bits[there]
                hit = (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
                there = there[hit.astype(bool)]
            alive = alive[there]
            out[alive] = q
        return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (chunk, ids, held, lens, tokens, vocab): documents as indexes into their chunk's words."""
    part, number = TaskContext.get().partitionId(), 0
    ids, held, toks, size = [], [], [], 0

    def row() -> pd.DataFrame:
        nonlocal ids, held, toks, size, number
        vocab, tokens = np.unique(np.concatenate(toks), return_inverse=True)
        lens = np.array([len(x) for x in toks], np.int64)
        there = np.array([i is not None and i == i for i in ids], bool)
        keys = np.array([i if ok else 0 for i, ok in zip(ids, there, strict=True)], np.int64)
        out = pd.DataFrame(
            {
                "chunk": [(part << 32) + number], "ids": [keys.tobytes()], "there": [there.tobytes()], "held": [np.array(held, bool).tobytes()],
                "lens": [lens.tobytes()], "tokens": [_pack(tokens.astype(np.uint32))], "vocab": [vocab.tobytes()], "n": [int(lens.sum())],
            }
        )
        ids, held, toks, size, number = [], [], [], 0, number + 1
        return out

    for pdf in batches:
        for i, text, h in zip(pdf["id"].astype(object), pdf["text"], pdf["held"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            held.append(bool(h))
            toks.append(np.append(hashes(words(text)), END))
            size += len(text or "") + 64
            if size >= CHUNK_BYTES:
                yield row()
    if ids:
        yield row()
    give_back()


_CHUNK = "chunk long, ids binary, there binary, held binary, lens binary, tokens binary, vocab binary, n long"


def _unigrams(vocab: np.ndarray, segments: int) -> np.ndarray:
    return ((vocab >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def _bigrams(r, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and fingerprint of the bigram that ends at each token."""
    tokens, vocab = _unpack(r.tokens, np.uint32), np.frombuffer(r.vocab, np.uint64)
    lens = np.frombuffer(r.lens, np.int64)
    h = vocab[tokens]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(lens) - lens] = START
    key = scramble(before * MIX + h)
    return ((key >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), key.astype(np.uint32)


def _slices(seg: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(seg):
        cuts = np.flatnonzero(np.diff(seg)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(seg)), strict=True):
            yield int(seg[a]), slice(int(a), int(b))


def _requests(segments: int):
    """Rows (chunk, seg, items, counts): the chunk's distinct words of a segment, and how often training rows have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                vocab, tokens = np.frombuffer(r.vocab, np.uint64), _unpack(r.tokens, np.uint32)
                train = ~np.repeat(np.frombuffer(r.held, bool), np.frombuffer(r.lens, np.int64))
                counts = np.bincount(tokens[train], minlength=len(vocab)).astype(np.uint32)
                seg = _unigrams(vocab, segments)
                order = np.argsort(seg, kind="stable")
                vocab, counts = vocab[order], counts[order]
                out = [(r.chunk, s, vocab[k].tobytes(), _pack(counts[k])) for s, k in _slices(seg[order])]
                yield pd.DataFrame(out, columns=["chunk", "seg", "items", "counts"])

    return run


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of a segment's words over all training rows, for each chunk in its own order."""
    items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
    counts = np.concatenate([_unpack(x, np.uint32) for x in pdf["counts"]])
    vocab, where = np.unique(np.concatenate(items), return_inverse=True)
    total = np.bincount(where, counts, minlength=len(vocab)).astype(np.int64)
    out, at = [], 0
    for x in items:
        out.append(_pack(total[where[at : at + len(x)]]))
        at += len(x)
    return pd.DataFrame({"chunk": pdf["chunk"], "seg": pdf["seg"], "counts": out, "v": int((total > 0).sum()), "n": int(total.sum())})


def _distinct_bigrams(segments: int, train_only: bool):
    """Rows (chunk, seg, fps, counts): distinct bigrams of the chunk, with their counts in training rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                seg, fp = _bigrams(r, segments)
                train = ~np.repeat(np.frombuffer(r.held, bool), np.frombuffer(r.lens, np.int64))
                key = (seg.astype(np.uint64) << np.uint64(32)) | fp
                if train_only:
                    key = key[train]
                key, counts = np.unique(key, return_counts=True)
                seg, fp = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
                out = [(r.chunk, s, fp[k].tobytes(), _pack(counts[k].astype(np.uint32))) for s, k in _slices(seg)]
                yield pd.DataFrame(out, columns=["chunk", "seg", "fps", "counts"])

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    give_back()
    fp = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["fps"]])
    counts = np.concatenate([_unpack(x, np.uint32) for x in pdf["counts"]])
    fp, where = np.unique(fp, return_inverse=True)
    seg, bits, raw = Filter.build(int(pdf["seg"].iloc[0]), fp, np.bincount(where, counts).astype(np.int64))
    return pd.DataFrame({"seg": [seg], "bits": [bits], "raw": [raw], "size": [len(raw)]})


def _probe(segments: int):
    """Beyond the broadcast bound: a segment answers the probes of every chunk."""

    def run(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        f = Filter([(int(x.seg), int(x.bits), len(x.raw)) for x in filters.itertuples()], b"".join(filters["raw"]), segments)
        out = []
        for r in asked.itertuples():
            fp = np.frombuffer(r.fps, np.uint32)
            out.append(_pack(f.levels(np.full(len(fp), r.seg), fp)))
        return pd.DataFrame({"chunk": asked["chunk"], "seg": asked["seg"], "counts": out}, columns=["chunk", "seg", "counts"])

    return run


#: The filter that this worker has unpacked, by a token of its run.
_held: dict[str, Filter] = {}


def _scores(segments: int, total: int, distinct: int, mu: float, filters, token: str):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        give_back()
        r = next(chunk.itertuples())
        vocab, tokens, lens = np.frombuffer(r.vocab, np.uint64), _unpack(r.tokens, np.uint32), np.frombuffer(r.lens, np.int64)
        seg = _unigrams(vocab, segments)
        order, counts = np.argsort(seg, kind="stable"), np.zeros(len(vocab), np.int64)
        mine = answers[answers["what"] == 0].sort_values("seg")
        counts[order] = np.concatenate([_unpack(x, np.int64) for x in mine["counts"]])
        p1 = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        first = np.cumsum(lens) - lens
        context = np.empty(len(tokens))
        context[1:] = counts[tokens[:-1]]
        ends = counts[np.searchsorted(vocab, END)]
        context[first] = ends  # as many starts as ends
        bseg, bfp = _bigrams(r, segments)
        key, where = np.unique((bseg.astype(np.uint64) << np.uint64(32)) | bfp, return_inverse=True)
        if filters is not None:
            if token not in _held:
                _held.clear()
                _held[token] = Filter(*filters.value)
            level = _held[token].levels((key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32))
        else:
            level = np.concatenate([_unpack(x, np.uint8) for x in answers[answers["what"] == 1].sort_values("seg")["counts"]])
        value = np.append(0, LEVELS)[level][where]
        p = p1[tokens]
        value = np.minimum(value, context)  # a false positive can't exceed its context
        model = np.log10((value + mu * p) / (context + mu))
        there = np.frombuffer(r.there, bool)
        return pd.DataFrame(
            {
                "id": pd.array(np.frombuffer(r.ids, np.int64), "Int64").copy() if there.all() else pd.array([int(i) if ok else None for i, ok in zip(np.frombuffer(r.ids, np.int64), there, strict=True)], "Int64"),
                "held_out": np.frombuffer(r.held, bool), "n_tokens": lens, "n_known": np.add.reduceat((counts > 0)[tokens].astype(np.int64), first),
                "train_tokens": total, "base_score": np.add.reduceat(np.log10(p1)[tokens], first), "score": np.add.reduceat(model, first),
            }
        )

    return run


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, mu: float = MU, broadcast_bytes: int = 128 << 20
) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from rows with crc32(id as text) mod folds <> held_fold; a null id
    counts as the empty text there and stays null in the result. A null text
    is empty: one end token; texts of any length are read whole (one that is
    longer than a chunk is a chunk of its own). Repeated rows count each time
    and get equal scores. Without training
    rows every count is zero. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (remainder(id_col, folds) == held_fold).alias("held")
    )
    chunks = materialise(plain.mapInPandas(_chunks, _CHUNK), "chunks")
    segments = max(8, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // SEGMENT_TOKENS))
    answers = materialise(
        chunks.mapInPandas(_requests(segments), "chunk long, seg long, items binary, counts binary")
        .groupBy("seg")
        .applyInPandas(_answers, "chunk long, seg long, counts binary, v long, n long"),
        "answers",
    )
    sums = answers.groupBy("seg").agg(F.max("v").alias("v"), F.max("n").alias("n")).agg(F.sum("v"), F.sum("n")).first()
    distinct, total = sums[0] or 0, sums[1] or 0
    filters = materialise(
        chunks.mapInPandas(_distinct_bigrams(segments, True), "chunk long, seg long, fps binary, counts binary")
        .groupBy("seg")
        .applyInPandas(_build, "seg long, bits long, raw binary, size long"),
        "filters",
    )
    reply = answers.select("chunk", "seg", "counts", F.lit(0).alias("what"))
    size = filters.agg(F.sum("size")).first()[0] or 0
    if size <= broadcast_bytes:
        parts, data = [], bytearray()
        for r in filters.select("seg", "bits", "raw").toLocalIterator():  # at most broadcast_bytes in all
            parts.append((r.seg, r.bits, len(r.raw)))
            data += r.raw
        held = spark.sparkContext.broadcast((parts, bytes(data), segments))
        del data
    else:
        held = None
        asked = chunks.mapInPandas(_distinct_bigrams(segments, False), "chunk long, seg long, fps binary, counts binary")
        levels = asked.groupBy("seg").cogroup(filters.groupBy("seg")).applyInPandas(_probe(segments), "chunk long, seg long, counts binary")
        reply = reply.unionByName(levels.withColumn("what", F.lit(1)))
    scored = (
        chunks.groupBy("chunk")
        .cogroup(reply.groupBy("chunk"))
        .applyInPandas(
            _scores(segments, total, distinct, mu, held, uuid.uuid4().hex),
            "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
    return scored.withColumnRenamed("id", id_col)
