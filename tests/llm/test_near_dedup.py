import re

import numpy as np
import pytest

from weft.llm import near_dedup as N
from weft.llm.queries import op4_setsketch_near_dedup


def sets(rows, k):
    out = []
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, k):
    rows = sets(rows, k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and (rows[a][0] == rows[b][0] or 100 * len(x & y) >= 80 * len(x | y)):
                parent[max(find(a), find(b), key=lambda p: rows[p][0])] = min(find(a), find(b), key=lambda p: rows[p][0])
    return [(i, len(s), rows[find(k)][0], i is None or i == rows[find(k)][0]) for k, (i, s) in enumerate(rows)]


order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert order(tuple(r) for r in op4_setsketch_near_dedup(spark, sf_dir).collect()) == order(brute(docs, 2))


@pytest.mark.parametrize("k", [2, 5])
def test_edge_rows(spark, edge, k):
    got = N.near_duplicates(edge, shingle=k).collect()
    assert order(tuple(r) for r in got) == order(brute([(r.doc_id, r.text) for r in edge.collect()], k))


def test_chains_and_large_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
    rows = []
    for g in range(3):  # drifting copies: neighbours are near, ends are far apart
        text = [f"g{g}{w}" for w in base]
        for _ in range(40):
            text = list(text)
            text[int(rng.integers(60))] = f"n{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + x, "one and the same text for all of these rows") for x in range(50)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert order(tuple(r) for r in got) == order(brute(rows, 2))


def test_ids_with_several_texts(spark):
    rng = np.random.default_rng(9)
    text = lambda k: " ".join(f"{k}{x}" for x in rng.integers(0, 900, 40))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (5, c), (7, c), (7, b + " other words"), (8, None), (8, ""), (4, c + " end"), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        got = N.near_duplicates(frame.repartition(3), shingle=2).collect()
        assert order(tuple(r) for r in got) == order(brute(rows, 2))


def test_recall_of_pairs_at_the_threshold():
    rng, n, met, kept = np.random.default_rng(10), 300, 0, 0
    for _ in range(n):
        one = rng.integers(0, 2**63, 900, dtype=np.uint64)
        two = np.append(one[:800], rng.integers(0, 2**63, 100, dtype=np.uint64))  # 800 of 1000 in common
        a, b = N.registers(one), N.registers(two)
        met += bool((N.band_keys(a) == N.band_keys(b)).any())
        counts = [np.array([x.sum()]) for x in (a < b, a == b, a > b)]
        size = np.array([900.0])
        likely = N.estimate(*counts, size, size)[0] >= 0.8 - N.SLACK
        kept += likely
        assert likely == N.reaches(*counts, size, size, 0.8 - N.SLACK)[0]
    assert met == kept == n  # 0.999997 of pairs expected


def test_empty(empty):
    assert N.near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 900, dtype=np.uint64)
    b[:800] = a[:800]
    ra, rb = N.registers(a), N.registers(b)
    assert (N.merge(ra, rb) == N.registers(np.union1d(a, b))).all()
    j = N.estimate(np.array([(ra < rb).sum()]), np.array([(ra == rb).sum()]), np.array([(ra > rb).sum()]), np.array([900.0]), np.array([900.0]))
    assert abs(j[0] - 0.8) < 0.12


def test_torn_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(80)]
    rows = []
    for k in range(130):  # similarities between copies lie around the threshold
        text = list(base)
        for at in rng.integers(0, 80, 3 + k % 5):
            text[int(at)] = f"n{rng.integers(10**9)}" if k % 3 else f"m{at}"
        rows.append((k, " ".join(text)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert order(tuple(r) for r in got) == order(brute(rows, 2))


def test_intersections(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 60, n, dtype=np.uint64)) for n in (1, 5, 40, 90)] for _ in range(2))
    assert (N.intersections(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


@pytest.mark.parametrize("name", ["gone", "digest", "leader", "known", "least", "text_", "m"])
def test_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, None)], f"doc_id long, text string, `{name}` string")
    kept = N.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
