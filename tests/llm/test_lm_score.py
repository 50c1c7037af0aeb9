import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weft.llm.lm_score import LEVELS, MU, Filter, lm_scores
from weft.llm.queries import op1_lm_scores


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def brute(rows):
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for i, t in rows:
        w = tokens(t)
        score = 0.0
        for a, b in zip(["<s>", *w], w, strict=False):
            c = bi[a, b]
            q = int(LEVELS[np.searchsorted(LEVELS, c, side="right") - 1]) if c else 0
            context = uni["\n"] if a == "<s>" else uni[a]
            score += math.log10((q + MU * p1(b)) / (context + MU))
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == tuple(w[:5])
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-2, abs=3)  # the filter's false positives
    gap = [abs(g[6] - w[6]) / w[2] for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True)]
    assert float(np.median(gap)) < 0.003


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    compare(op1_lm_scores(spark, sf_dir).collect(), brute(docs))


@pytest.mark.parametrize("bound", [128 << 20, 0])
def test_edge_rows(spark, edge, bound):
    got = lm_scores(edge, broadcast_bytes=bound).collect()
    compare(got, brute([(r.doc_id, r.text) for r in edge.collect()]))


def test_empty(spark, empty):
    assert lm_scores(empty).count() == 0


def test_filter_levels():
    fp = np.arange(5000, dtype=np.uint32) * np.uint32(2654435761)
    counts = (np.arange(5000) % 200 + 1).astype(np.int64)
    seg, bits, raw = Filter.build(0, fp, counts)
    f = Filter([(seg, bits, len(raw))], raw, 1)
    seg = np.zeros(5000, np.int64)
    level = f.levels(seg, fp)
    true = np.searchsorted(LEVELS, counts, side="right")
    assert (level >= true).all() and (level == true).mean() > 0.98
    assert (f.levels(seg, fp + np.uint32(1)) > 0).mean() < 0.02
