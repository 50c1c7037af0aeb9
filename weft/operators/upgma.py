"""Average-linkage clustering of sparse edges; absent pairs count as psi.

Three ways to the same forest:

* ``components``: each connected component is clustered by a heap in one
  grouped task. For graphs whose components fit a task.
* ``rounds``: memory-bounded. The M smallest edges are loaded by one task of
  an executor, unknown pairs carry the interval [lambda, psi], and merging goes
  on while the next merge is certain and its height exact; then all edges are
  remapped, collated and thickened by DataFrame operations, and the next round
  begins. Each round's merges, sizes and edges are written tables, so a run
  that was stopped goes on from its last whole round.
* ``reciprocal``: all mutually nearest pairs merge at once, each round in
  DataFrame operations alone; no component has to fit anywhere. Exact because
  average linkage is reducible; among equal distances it may order merges
  otherwise than the heap.

Merges at equal height go by higher low id first, then higher high id. Merged
ids count from max_singleton + 1 in order of merging over the whole forest.
"""

from __future__ import annotations

import heapq
import logging
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.linkage import averager
from weft.operators.components import connected_components
from weft.operators.edges import collate, remap, root_map, thicken, top_edges
from weft.sources.edges import checked, max_singleton
from weft.sources.matrix import MAX_FEATURES
from weft.storage import discard, materialise, new_path, written

log = logging.getLogger(__name__)
FOREST = "c1 long, c2 long, height double, merged long, merge_no long"
#: Edges of a component that one task may hold; larger components go by reciprocal rounds.
KERNEL_EDGES = 20_000_000


def cluster(rows: Iterable[tuple[int, int, float]], psi: float, first_id: int, rule: str = "arithmetic", sizes: dict[int, int] | None = None) -> Iterator[tuple[int, int, float, int]]:
    """Merges (low, high, height, merged) of one edge list, in order."""
    mean = averager(rule)
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for i, j, d in rows:
        near[i][j] = near[j][i] = d
    size = defaultdict(lambda: 1, sizes or {})
    heap = [(d, -min(u, v), -max(u, v)) for u, own in near.items() for v, d in own.items() if u < v]
    heapq.heapify(heap)
    new = first_id
    while heap:
        d, low, high = heapq.heappop(heap)
        a, b = -low, -high
        if near.get(a, {}).get(b) != d:
            continue  # one of the two is gone
        if d > psi:
            break
        na, nb = near.pop(a), near.pop(b)
        del na[b], nb[a]
        own: dict[int, float] = {}
        for v in na.keys() | nb.keys():
            other = near[v]
            other.pop(a, None)
            other.pop(b, None)
            own[v] = other[new] = mean(size[a], na.get(v, psi), size[b], nb.get(v, psi))
            heapq.heappush(heap, (own[v], -v, -new))
        near[new] = own
        size[new] = size[a] + size[b]
        yield a, b, d, new
        new += 1


def cluster_certain(rows: list[tuple[int, int, float]], full: bool, psi: float, first_id: int, sizes: dict[int, int], relaxed: bool = False) -> Iterator[tuple[int, int, float, int]]:
    """The merges that are certain while pairs that aren't loaded may lie anywhere from lambda to psi.

    full: whether edges were left out, so that lambda is the largest loaded
    distance; otherwise nothing is unknown and lambda is psi. relaxed: go on
    while at most one other pair may be nearer; the result is then no
    dendrogram and its heights are upper bounds.
    """
    lam = max(d for _, _, d in rows) if full else psi
    near: dict[int, dict[int, tuple[float, float]]] = defaultdict(dict)
    for i, j, d in rows:
        near[i][j] = near[j][i] = (d, d)
    size = defaultdict(lambda: 1, sizes)
    upper = [(d, -min(i, j), -max(i, j)) for i, j, d in rows]
    lower = list(upper)
    heapq.heapify(upper)
    heapq.heapify(lower)
    new, unknown = first_id, (lam, psi)

    def top(heap: list, side: int) -> tuple | None:
        while heap:
            d, low, high = heap[0]
            found = near.get(-low, {}).get(-high)
            if found is not None and found[side] == d:
                return heap[0]
            heapq.heappop(heap)
        return None

    while best := top(upper, 1):
        ub, low, high = best
        a, b = -low, -high
        lb = near[a][b][0]
        least = top(lower, 0)
        if relaxed and least[0] < ub and least[1:] != best[1:]:
            aside = heapq.heappop(lower)
            second = top(lower, 0)
            heapq.heappush(lower, aside)
            uncertain = second is not None and second[0] < ub and second[1:] != best[1:]
        else:
            uncertain = not relaxed and (lb != ub or least[0] < ub)
        if ub > lam or uncertain:
            return
        na, nb = near.pop(a), near.pop(b)
        del na[b], nb[a]
        own = {}
        n1, n2 = size[a], size[b]
        for v in na.keys() | nb.keys():
            near[v].pop(a, None)
            near[v].pop(b, None)
            x, y = na.get(v, unknown), nb.get(v, unknown)
            own[v] = near[v][new] = tuple((n1 * p + n2 * q) / (n1 + n2) for p, q in zip(x, y, strict=True))
            heapq.heappush(lower, (own[v][0], -v, -new))
            heapq.heappush(upper, (own[v][1], -v, -new))
        near[new] = own
        size[new] = n1 + n2
        yield a, b, ub, new
        new += 1


def numbered(merges: list[tuple[object, object, float, object]], first_id: int) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, key) with provisional keys above singletons, in the global order with final ids.

    At most one row a feature, so the driver holds at most MAX_FEATURES rows.
    """
    waits: dict[object, list[int]] = defaultdict(list)
    made = {m[3] for m in merges}
    missing = []
    final: dict[object, int] = {}
    heap: list[tuple[float, int, int, int]] = []

    def ready(k: int) -> None:
        a, b = (final.get(x, x) for x in merges[k][:2])
        heapq.heappush(heap, (merges[k][2], -min(a, b), -max(a, b), k))

    for k, (a, b, _, _) in enumerate(merges):
        open_ = [x for x in (a, b) if x in made]
        missing.append(len(open_))
        for x in open_:
            waits[x].append(k)
        if not open_:
            ready(k)
    out = []
    while heap:
        h, low, high, k = heapq.heappop(heap)
        new = first_id + len(out)
        out.append((-low, -high, h, new))
        final[merges[k][3]] = new
        for w in waits[merges[k][3]]:
            missing[w] -= 1
            if not missing[w]:
                ready(w)
    return out


def _forest(spark, rows: list[tuple[int, int, float, int]]) -> DataFrame:
    pdf = pd.DataFrame(rows, columns=["c1", "c2", "height", "merged"]).assign(merge_no=range(1, len(rows) + 1))
    return spark.createDataFrame(pdf.astype({"c1": "int64", "c2": "int64", "height": "float64", "merged": "int64", "merge_no": "int64"}), FOREST)


def _start(edges: DataFrame, psi: float, singletons: int | None) -> tuple[DataFrame, int]:
    legal = materialise(checked(edges.select("i", "j", "dist"), psi), "edges")
    top = max_singleton(legal)
    n = top if singletons is None else singletons
    if n < top:
        raise ValueError(f"max_singleton {n} is below the largest id {top}")
    if n > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    return legal, n


def _component_kernel(psi: float, n: int, rule: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = zip(pdf["i"].tolist(), pdf["j"].tolist(), pdf["dist"].tolist(), strict=True)
        return pd.DataFrame(list(cluster(rows, psi, n + 1, rule)), columns=["a", "b", "height", "key"]).assign(component=pdf["component"].iloc[0])

    return run


def upgma(edges: DataFrame, psi: float = 1.0, singletons: int | None = None, rule: str = "arithmetic", kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """The merge forest (c1, c2, height, merged, merge_no) of edges (i, j, dist)."""
    averager(rule)
    legal, n = _start(edges, psi, singletons)
    near = connected_components(legal)
    tagged = legal.join(near.select(F.col("node").alias("i"), "component"), "i")
    large = [r.component for r in tagged.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > kernel_edges).select("component").collect()]
    if large and rule != "arithmetic":
        raise ValueError(f"a component has more than {kernel_edges} edges; only arithmetic linkage goes by rounds")
    small = tagged.where(~F.col("component").isin(large)) if large else tagged
    found = small.groupBy("component").applyInPandas(_component_kernel(psi, n, rule), "a long, b long, height double, key long, component long")
    key = lambda c, x: x if x <= n else (c, x)
    merges = [(key(r.component, r.a), key(r.component, r.b), r.height, (r.component, r.key)) for r in found.toLocalIterator()]
    if large:
        merges += _reciprocal(tagged.where(F.col("component").isin(large)).select("i", "j", "dist"), psi, n)
    return _forest(edges.sparkSession, numbered(merges, n + 1))


ROUND = "c1 long, c2 long, height double, merged long, size long"


def _round_kernel(full: bool, psi: float, first_id: int, relaxed: bool):
    """One round's merges, from edges (i, j, dist, si, sj) that reach one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        if not parts:
            return
        pdf = pd.concat(parts)
        del parts
        size = dict(zip(pdf["i"].tolist(), pdf["si"].tolist(), strict=True)) | dict(zip(pdf["j"].tolist(), pdf["sj"].tolist(), strict=True))
        rows = list(zip(pdf["i"].tolist(), pdf["j"].tolist(), pdf["dist"].tolist(), strict=True))
        out = []
        for a, b, height, new in cluster_certain(rows, full, psi, first_id, size, relaxed):
            size[new] = size[a] + size[b]
            out.append((a, b, height, new, size[new]))
        yield pd.DataFrame(out, columns=["c1", "c2", "height", "merged", "size"])

    return run


def upgma_rounds(
    edges: DataFrame, psi: float = 1.0, singletons: int | None = None, m: int = 10_000_000, iterations: int = 1000, relaxed: bool = False, path: str | None = None, recorded: bool = False
) -> DataFrame:
    """The same forest with at most m edges loaded at a time; see cluster_certain for relaxed.

    recorded: with the columns round, n_edges (edges before the round) and
    live (merged clusters that were alive before it). path: a shared folder
    for the rounds' tables; a run that finds whole rounds there goes on after
    the last of them.
    """
    if m <= 0 or iterations <= 0:
        raise ValueError("m and iterations must be above 0")
    spark = edges.sparkSession
    path = path or new_path(spark, "rounds")
    now, n = _start(edges, psi, singletons)
    sizes, made, parts = spark.createDataFrame([], "id long, size long"), 0, []
    at = lambda k, name: f"{path.rstrip('/')}/{k}-{name}"

    def kept(df: DataFrame, k: int, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(at(k, name))
        return spark.read.parquet(at(k, name))

    ended = False
    for k in range(1, iterations + 1):
        if written(spark, at(k, "sizes")):  # the last table of a round
            part, now, sizes = (spark.read.parquet(at(k, x)) for x in ("merges", "edges", "sizes"))
        else:
            total = now.count()
            if not total:
                ended = True
                break
            of = lambda a, b: sizes.select(F.col("id").alias(a), F.col("size").alias(b))  # noqa: B023, E731
            loaded = top_edges(now.select("i", "j", "dist"), m).join(of("i", "si"), "i", "left").join(of("j", "sj"), "j", "left")
            loaded = loaded.select("i", "j", "dist", F.coalesce("si", F.lit(1)).alias("si"), F.coalesce("sj", F.lit(1)).alias("sj"))
            found = loaded.coalesce(1).mapInPandas(_round_kernel(total > m, psi, n + 1 + made, relaxed), ROUND)
            counted = [F.lit(x).cast("long").alias(name) for x, name in ((k, "round"), (total, "n_edges"), (sizes.count(), "live"))]
            part = kept(found.select("*", *counted), k, "merges")
            roots = root_map(part.select("c1", "c2", "height", "merged"))
            grown = part.join(roots.where("id = root").select(F.col("id").alias("merged")), "merged").select(F.col("merged").alias("id"), "size")
            after = sizes.join(roots.select("id"), "id", "left_anti").unionByName(grown)
            rest = kept(thicken(collate(remap(now, roots, sizes)), after, psi) if total > m else now.limit(0).select("i", "j", "dist"), k, "edges")
            now, sizes = rest, kept(after, k, "sizes")
        more = part.count()
        if not more:
            raise RuntimeError("a round merged nothing")
        made += more
        parts.append(part)
        log.info("round %d: %d merges, %d in all", k, more, made)
    if not ended and not now.isEmpty():
        raise RuntimeError(f"edges are left after {iterations} rounds")
    forest = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{ROUND}, round long, n_edges long, live long")
    more = ["round", "n_edges", "live"] if recorded else []
    return forest.select("c1", "c2", "height", "merged", (F.col("merged") - n).alias("merge_no"), *more)


def round_report(recorded: DataFrame) -> DataFrame:
    """(round, n_edges, live, merges, max_height, last_height, last_merged) of a recorded forest."""
    return recorded.groupBy("round").agg(
        F.max("n_edges").alias("n_edges"), F.max("live").alias("live"), F.count("*").alias("merges"), F.max("height").alias("max_height"), F.max_by("height", "merged").alias("last_height"), F.max("merged").alias("last_merged")
    )


def _reciprocal(edges: DataFrame, psi: float, n: int, iterations: int = 10_000) -> list[tuple[object, object, float, object]]:
    """Merges with provisional keys, by rounds of mutually nearest pairs."""
    spark = edges.sparkSession
    now, sizes = edges, spark.createDataFrame([], "id long, size long")
    top, out = n, []
    for _ in range(iterations):
        order = F.struct("dist", -F.col("i"), -F.col("j"))
        ends = now.select("i", "j", "dist", order.alias("o"), F.explode(F.array("i", "j")).alias("u"))
        best = ends.groupBy("u").agg(F.min_by(F.struct("i", "j", "dist"), "o").alias("b"))
        mutual = best.groupBy("b.i", "b.j", "b.dist").agg(F.count("*").alias("n")).where("n = 2")
        part = materialise(mutual.select(F.col("i").alias("c1"), F.col("j").alias("c2"), F.col("dist").alias("height"), (F.monotonically_increasing_id() + top + 1).alias("merged")), "merges")
        found = part.collect()  # at most half of the clusters
        if not found:
            return out
        out += [(r.c1 if r.c1 <= n else ("r", r.c1), r.c2 if r.c2 <= n else ("r", r.c2), r.height, ("r", r.merged)) for r in found]
        top = max(r.merged for r in found)
        roots = part.select(F.col("c1").alias("id"), F.col("merged").alias("root")).unionAll(part.select("c2", "merged"))
        one = lambda c: F.coalesce(c, F.lit(1))
        grown = part.join(sizes.select(F.col("id").alias("c1"), F.col("size").alias("s1")), "c1", "left").join(sizes.select(F.col("id").alias("c2"), F.col("size").alias("s2")), "c2", "left")
        kept = sizes.join(roots.select("id"), "id", "left_anti").unionByName(grown.select(F.col("merged").alias("id"), (one("s1") + one("s2")).cast("long").alias("size")))
        after = materialise(kept, "sizes")
        nxt = materialise(thicken(collate(remap(now, roots, sizes)), after, psi), "edges")
        for t in (now, sizes):
            discard(t)
        now, sizes = nxt, after
    raise RuntimeError(f"edges are left after {iterations} rounds")


def upgma_reciprocal(edges: DataFrame, psi: float = 1.0, singletons: int | None = None) -> DataFrame:
    """The forest by rounds of mutually nearest pairs."""
    legal, n = _start(edges, psi, singletons)
    merges = _reciprocal(legal.select("i", "j", "dist"), psi, n) if not legal.isEmpty() else []
    return _forest(edges.sparkSession, numbered(merges, n + 1))
