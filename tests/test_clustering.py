import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.functions.linkage import RULES, averager
from weft.operators import forest as FO
from weft.operators import upgma as U
from weft.operators.components import connected_components
from weft.operators.edges import all_sizes, root_map
from weft.queries import GRAPH, MERGES, PSI, SINGLETONS

METHODS = {
    "components": lambda e, n: U.upgma(e, 1.0, n),
    "rounds": lambda e, n: U.upgma_rounds(e, 1.0, n, m=7),
    "reciprocal": lambda e, n: U.upgma_reciprocal(e, 1.0, n),
}


def brute(rows, psi, n, rule="arithmetic"):
    """Average linkage over a full matrix with psi where no edge is, merging only along paths of edges."""
    mean = averager(rule)
    d, size, out = {}, {}, []
    for i, j, x in rows:
        d[i, j] = d[j, i] = x
        size[i] = size[j] = 1
    alive, new = set(size), n + 1
    while True:
        best = min(((d[a, b], -a, -b) for a, b in itertools.combinations(sorted(alive), 2) if (a, b) in d), default=None)
        if best is None or best[0] > psi:
            return out
        a, b = -best[1], -best[2]
        alive -= {a, b}
        for v in alive:
            if (a, v) in d or (b, v) in d:
                d[new, v] = d[v, new] = mean(size[a], d.get((a, v), psi), size[b], d.get((b, v), psi))
        size[new] = size[a] + size[b]
        alive.add(new)
        out.append((a, b, best[0], new))
        new += 1


def graph(seed, n=24, density=0.25):
    rng = np.random.default_rng(seed)
    return [(i, j, float(rng.random())) for i, j in itertools.combinations(range(1, n + 1), 2) if rng.random() < density]


@pytest.mark.parametrize("first", [SINGLETONS, 100])
def test_known_tree_in_both_id_bases(first):
    got = U.numbered([(a, b, h, ("x", m)) if False else (a, b, h, m) for a, b, h, m in U.cluster(GRAPH, PSI, first + 1)], first + 1)
    shift = lambda x: x if x <= SINGLETONS else x + first - SINGLETONS
    for g, w in zip(got, MERGES, strict=True):
        assert g[:2] == (shift(w[0]), shift(w[1])) and g[3] == shift(w[3])
        assert g[2] == pytest.approx(w[2], rel=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 30), st.floats(0.05, 1.0), st.sampled_from(RULES))
def test_heap_equals_brute_force(seed, n, density, rule):
    rows = graph(seed, n, density)
    want = brute(rows, 1.0, n, rule)
    got = list(U.cluster(rows, 1.0, n + 1, rule))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_certain_merges_are_a_prefix(seed, m):
    rows = sorted(graph(seed, 20, 0.4), key=lambda r: r[2])
    want = brute(rows, 1.0, 20)
    got = list(U.cluster_certain(rows[:m], m < len(rows), 1.0, 21, {}))
    assert got or not rows
    for g, w in zip(got, want, strict=False):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2])


def test_relaxed_rounds_merge_at_least_as_much():
    for seed in range(40):
        rows = sorted(graph(seed, 20, 0.4), key=lambda r: r[2])
        strict, loose = (list(U.cluster_certain(rows[:25], True, 1.0, 21, {}, relaxed)) for relaxed in (False, True))
        assert len(loose) >= len(strict) and loose[: len(strict)] == strict


@pytest.mark.parametrize("method", METHODS)
def test_methods_agree(spark, method):
    rows = graph(11, 22, 0.12)
    found = METHODS[method](spark.createDataFrame(rows, "i long, j long, dist double"), 30).orderBy("merge_no").collect()
    want = brute(rows, 1.0, 30)
    assert [(r.c1, r.c2, r.merged) for r in found] == [(a, b, m) for a, b, _, m in want]
    assert np.allclose([r.height for r in found], [w[2] for w in want])


def test_large_components_go_by_rounds(spark):
    rows = graph(5, 20, 0.3)
    e = spark.createDataFrame(rows, "i long, j long, dist double")
    a, b = (sorted(map(tuple, U.upgma(e, 1.0, 20, kernel_edges=k).select("c1", "c2", "merged").collect())) for k in (10, 10**6))
    assert a == b


def test_forest_invariants(spark):
    rows = graph(3, 40, 0.06)
    e = spark.createDataFrame(rows, "i long, j long, dist double")
    f = U.upgma(e, 1.0, 40)
    members = FO.tree_members(f)
    heights = [r.height for r in f.orderBy("merge_no").collect()]
    assert heights == sorted(heights)
    leaves = {}
    for r in members.collect():
        if r.id <= 40:
            leaves.setdefault(r.tree_id, set()).add(r.id)
    near = {}
    for r in connected_components(e).collect():
        near.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, leaves.values())) == sorted(map(sorted, near.values()))
    roots = {r.id: r.root for r in root_map(f).collect()}
    sizes = {r.id: r.size for r in all_sizes(f, 40).collect()}
    for own in leaves.values():
        (root,) = {roots[x] for x in own}
        assert sizes[root] == len(own)
    order = FO.leaf_order(f, members, 40).collect()
    assert sorted(r.feature_id for r in order) == sorted(set().union(*leaves.values()))
    labels = FO.relabelled(members, 40).collect()
    for t in leaves:
        own = sorted(r.label for r in labels if r.tree_id == t)
        assert own == list(range(1, len(own) + 1))


def test_illegal_input(spark):
    for rows in ([(1, 1, 0.5)], [(0, 2, 0.5)], [(1, 2, float("nan"))], [(1, 2, None)]):
        with pytest.raises(ValueError):
            U.upgma(spark.createDataFrame(rows, "i long, j long, dist double"))
    with pytest.raises(ValueError):
        U.upgma(spark.createDataFrame([(1, 9, 0.5)], "i long, j long, dist double"), singletons=5)
    with pytest.raises(ValueError):
        U.upgma(spark.createDataFrame([(1, 9, 0.5)], "i long, j long, dist double"), rule="median")
    far = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.5)], "i long, j long, dist double")
    assert [(r.c1, r.c2) for r in U.upgma(far).collect()] == [(1, 2)]
    assert U.upgma(far.limit(0)).count() == 0 and U.upgma_reciprocal(far.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(0, 300).selectExpr("id i", "id + 1 j")
    got = connected_components(chain.unionAll(spark.sql("SELECT 1000L, 1000L UNION ALL SELECT null, 5L UNION ALL SELECT 2000L, 2001L")))
    assert {r.component for r in got.where("node < 1000").collect()} == {0} and got.where("node >= 1000").count() == 2


def test_rounds_go_on_after_the_last_whole_one(spark, tmp_path):
    edges, path = spark.createDataFrame(GRAPH, "i long, j long, dist double"), f"file://{tmp_path}/rounds"
    with pytest.raises(RuntimeError, match="left after 2 rounds"):
        U.upgma_rounds(edges, PSI, SINGLETONS, m=5, iterations=2, path=path)
    (tmp_path / "rounds" / "2-sizes" / "_SUCCESS").unlink()  # as if the second round had not been written to its end
    got = U.upgma_rounds(edges, PSI, SINGLETONS, m=5, path=path, recorded=True).orderBy("merge_no").collect()
    assert [(r.c1, r.c2, r.merged) for r in got] == [(a, b, m) for a, b, _, m in MERGES]
    assert [r["round"] for r in got] == [1, 1, 2, 2, 2, 3, 3, 3, 3]
    report = U.round_report(U.upgma_rounds(edges, PSI, SINGLETONS, m=5, recorded=True)).orderBy("round").collect()
    assert [(r.n_edges, r.live, r.merges, r.last_merged) for r in report] == [(14, 0, 2, 25), (9, 1, 3, 28), (4, 2, 4, 32)]
