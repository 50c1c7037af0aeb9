import numpy as np
import pytest

from weft.llm import embed_dedup as E
from weft.llm.queries import op7_embedding_near_dedup


def brute(rows, least=0.98):
    ok = []
    for i, v, label in rows:
        good = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if good else None
        ok.append(x / np.abs(x).max() if good else None)
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / (np.sqrt(ok[a] @ ok[a]) * np.sqrt(ok[b] @ ok[b])) >= least:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                    parent[y] = x
    return sorted(((r[0], links[k], rows[find(k)][0], r[0] is None or r[0] == rows[find(k)][0]) for k, r in enumerate(rows)), key=str)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    assert sorted(map(tuple, op7_embedding_near_dedup(spark, sf_dir).collect()), key=str) == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_groups_and_edges(spark, kind):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        base = rng.standard_normal(16)
        for k in range((3, 400, 9, 40, 1, 2)[g]):
            v = base if k % 3 == 0 else base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in v], (g % 4) if k % 11 else 3))
    extra = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0], [2.0], [float("inf")] + [0.0] * 15]
    rows += [(len(rows) + k, v, 1) for k, v in enumerate(extra)]
    rows += [(len(rows), rows[0][1], None), (None, rows[0][1], 0), (len(rows) + 2, [-0.0, 1.0], 1), (len(rows) + 3, [0.0, 2.0], 1)]
    if kind == "double":
        rows += [(len(rows) + 9, [1e300, 1e300], 1), (len(rows) + 10, [1e-300, 1e-300], 1)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'x' key", "1 rep", "2 links", "3 id").repartition(3)
    want = brute(rows)
    got = sorted(map(tuple, E.near_vectors(df).collect()), key=str)
    assert len(got) == len(want)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert all(a[1] <= b[1] and (a[2] is None or a[2] >= b[2]) for a, b in zip(sorted(got, key=lambda r: str(r[0])), sorted(want, key=lambda r: str(r[0])), strict=True))


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(k, [float(x) for x in base + 0.01 * rng.standard_normal(8)], 0) for k in range(150)]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_ids_with_several_vectors(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, x, 0), (5, x, 0), (5, y, 0), (2, y, 0), (7, z, 0), (3, z, 0), (9, None, 0), (None, x, 0)]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, 1, 1, True), (5, 1, 1, False), (5, 1, 1, False), (2, 1, 1, False), (7, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True), (None, 0, None, True)], key=str)
