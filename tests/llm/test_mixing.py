import re

import numpy as np
import pytest

from weft.llm import mixing as M
from weft.llm.queries import op6_mixing


def water(sizes):
    w = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    t, total = [0.0] * len(sizes), 1.5 * sum(sizes)
    capped = set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = total - sum(2 * sizes[k] for k in capped)
        t = [2.0 * sizes[k] if k in capped else left * w[k] / sum(w[j] for j in free) for k in range(len(sizes))]
        over = {k for k in free if t[k] > 2 * sizes[k]}
        if not over:
            return t
        capped |= over


def check(got, docs):
    assert len(got) == len(docs)
    size = {}
    for _, text, source in docs:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, water([size[s] for s in names]), strict=True))
    where = {}
    for i, text, source in docs:
        where.setdefault((i, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))), []).append(source)
    taken, largest = {}, {}
    for r in got:
        source = where[r.doc_id, r.size].pop()
        assert r.source_size == size[source] and r.target == pytest.approx(goal[source])
        assert r.taken in (0, r.size, 2 * r.size) and len(r.shards) * r.size == r.taken
        assert all(0 <= s < M.SHARDS for s in r.shards)
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), r.size)
    for s in names:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = op6_mixing(spark, sf_dir).collect()
    check(got, docs)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op6_mixing(spark, sf_dir).collect()))


def test_edge_rows_and_empty(spark, edge, empty):
    got = M.plan(edge).withColumnRenamed("id", "doc_id").collect()
    check(got, rows(edge))
    assert M.plan(empty).count() == 0 and M.mix(empty).count() == 0


def test_hot_source_and_copies(spark):
    docs = [(k, " ".join(["w"] * (k % 40)), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)] + [(None, "same words here", "copies")] * 500
    check(M.plan(spark.createDataFrame(docs, "doc_id long, text string, source string")).withColumnRenamed("id", "doc_id").collect(), docs)


def test_mixture_has_each_row_as_often_as_taken(spark, edge):
    docs = edge.where("doc_id is not null")
    want = sorted((r.id, len(r.shards)) for r in M.plan(docs).collect() if r.shards)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert sorted(got.items()) == want


def test_quotas_are_exact():
    q = np.array([100, 0, 7, 1000])
    out = M.split_quotas(q, 13, 3)
    assert (out.sum(axis=0) == q).all() and np.ptp(out.sum(axis=1)) <= 2
