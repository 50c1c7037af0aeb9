"""MinHash near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles. Each set gets a SetSketch:
registers ``K_i = floor(1 - log_b(min_x h_i(x)))`` over exponentially
distributed hashes, that is minima truncated to an exponentially spaced grid.
Registers are mergeable (maximum) and locality-sensitive, so groups of them
are banded for candidates. Candidates are first judged by the joint maximum
likelihood estimate of the Jaccard similarity from the counts of smaller,
equal and larger registers, and the survivors are verified on the full sets,
so no link is below the threshold.

Hot groups: equal sets collapse to one class before banding, and classes (the
digests of their sets) are what is linked; ids attach at the end. A band
bucket's members are first compared with its most central member, the one that
meets most others over all bands (a star, linear in the bucket). Where members
stay unconnected, the bucket is cut into blocks: those outside its largest
connected part meet all others, block by block. Sketches meet first and say
which members have any likely partner in a unit; only for these are the sets
made and intersected. Such a unit returns at most one edge a member, never
pairs, so nothing is capped or dropped and no output grows with the square of
a group.

Recall: a pair at the threshold of 0.8 shares at least one of the 32 bands of
5 registers with probability 1 - (1 - 0.8^5)^32 = 0.999997.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import HOT_SHARE, MIX, give_back, hashes, same_id, scramble, small_batches, unused, words
from weft.operators.components import connected_components
from weft.storage import discard, materialise

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_535
_rng = np.random.default_rng(20_240_601)
_XOR = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Candidates whose estimate is this far below the threshold are not verified;
#: six standard errors of the estimate at 160 registers.
SLACK = 6 * math.sqrt(0.25 / REGISTERS) * 0.8
#: Ids of candidates are broadcast up to this size; beyond it both sides shuffle.
BROADCAST_BYTES = 64 << 20


def shingle_set(tokens: list[bytes], k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer words make one shingle."""
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
    h = hashes(tokens)
    n = len(h) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc = scramble(acc * MIX + h[j : j + n])
    return np.unique(acc)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of hashes."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for k in range(0, len(items), 256):
        np.minimum(least, ((items[k : k + 256, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    uniform = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for col in regs.reshape(BANDS, ROWS).T.astype(np.uint64):
        acc = scramble(acc * MIX + col)
    return acc.view(np.int64)


_GRID = np.linspace(0, 1, 101)


def estimate(less: np.ndarray, equal: np.ndarray, more: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity by joint maximum likelihood, given the set sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.minimum(_GRID[None, :], top)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    same = np.maximum(1 - up - down, 1e-12)
    like = more[:, None] * np.log(up + 1e-12) + less[:, None] * np.log(down + 1e-12) + equal[:, None] * np.log(same)
    return j[np.arange(len(j)), like.argmax(axis=1)]


def reaches(less: np.ndarray, equal: np.ndarray, more: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate is at least so much: whether the likelihood, which has one peak, still rises there."""
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    def like(j: float) -> np.ndarray:
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return more * np.log(up + 1e-12) + less * np.log(down + 1e-12) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    return like(least + 0.005) >= like(least - 0.005)


def _signatures(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small_batches(batches):
            out = {"id": [], "n": [], "digest": [], "sketch": [], "keys": []}
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                items = shingle_set(words(text), k)
                out["id"].append(i)
                out["n"].append(len(items))
                if len(items):
                    regs = registers(items)
                    out["digest"].append(xxhash.xxh3_128_digest(items.tobytes()))
                    out["sketch"].append(regs.tobytes())
                    out["keys"].append(band_keys(regs))
                else:
                    for c in ("digest", "sketch", "keys"):
                        out[c].append(None)
            out["id"] = pd.array(out["id"], dtype="Int64")
            yield pd.DataFrame(out)

    return run


def _sets(k: int):
    """The sets of rows whose text has the wanted digest; an id may stand at several texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small_batches(batches):
            out = []
            for digest, text in zip(pdf["digest"], pdf["text"], strict=True):
                items = shingle_set(words(text), k).tobytes()
                if xxhash.xxh3_128_digest(items) == digest:
                    out.append((digest, items))
            yield pd.DataFrame(out, columns=["digest", "items"])

    return run


def _likely(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small_batches(batches, 4096):
            if not len(pdf):
                continue
            a = np.frombuffer(b"".join(pdf["sa"]), np.uint16).reshape(-1, REGISTERS)
            b = np.frombuffer(b"".join(pdf["sb"]), np.uint16).reshape(-1, REGISTERS)
            na, nb = pdf["na"].to_numpy(float), pdf["nb"].to_numpy(float)
            j = estimate((a < b).sum(1), (a == b).sum(1), (a > b).sum(1), na, nb)
            yield pdf.loc[j >= threshold - SLACK, ["a", "b"]]

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small_batches(batches):
            keep = []
            for x, y in zip(pdf["xa"], pdf["xb"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


#: Members to a block of a torn bucket, and columns of an intersection that are held at a time.
BLOCK, COLUMNS = 512, 1 << 14


def _held(batch: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    """(sets, shared items) indicator of which set has which item."""
    out = np.zeros((len(batch), len(shared)), np.float32)
    for row, items in enumerate(batch):
        at = np.searchsorted(shared, items)
        at[at == len(shared)] = 0
        out[row, at[shared[at] == items]] = 1
    return out


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets a with sets b, in bounded memory."""
    total = np.zeros((len(a), len(b)), np.int64)
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    for k in range(0, len(shared), COLUMNS):
        part = shared[k : k + COLUMNS]
        lo, hi = part[0], part[-1]
        cut = lambda x: x[np.searchsorted(x, lo) : np.searchsorted(x, hi, side="right")]  # noqa: E731, B023
        total += np.rint(_held([cut(x) for x in a], part) @ _held([cut(x) for x in b], part).T).astype(np.int64)
    return total


def _sides(unit: pd.DataFrame, num: int, den: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray] | None:
    """The two sides of a unit and which pairs of them may be linked by size and lie in different parts."""
    side = unit["side"].to_numpy()
    a = unit[side == 0]
    b = unit[side == 1] if (side == 1).any() else a
    if not len(a) or not len(b):
        return None
    na, nb = a["n"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
    parts = pd.factorize(pd.concat([a["comp"], b["comp"]]))[0]
    may = (den * np.minimum(na[:, None], nb) >= num * np.maximum(na[:, None], nb)) & (parts[: len(a), None] != parts[len(a) :])
    return (a, b, may) if may.any() else None


def _unit_survivors(unit: pd.DataFrame, num: int, den: int) -> pd.DataFrame | None:
    """Members of a unit that have a likely partner in it, by their sketches."""
    if (sides := _sides(unit, num, den)) is None:
        return None
    a, b, may = sides
    sketch = lambda x: np.frombuffer(b"".join(x["sketch"]), np.uint16).reshape(-1, REGISTERS)
    sa, sb = sketch(a), sketch(b)
    na, nb = a["n"].to_numpy(float), b["n"].to_numpy(float)
    for k in range(len(a)):
        own = np.flatnonzero(may[k])
        if len(own):
            other = sb[own]
            equal, less = (other == sa[k]).sum(axis=1), (other > sa[k]).sum(axis=1)
            may[k, own] = reaches(less, equal, REGISTERS - equal - less, na[k], nb[own], num / den - SLACK)
    keep = ["key", "x", "y", "side", "digest", "comp", "n"]
    if a is b:
        return a.loc[may.any(axis=1) | may.any(axis=0), keep]
    return pd.concat([a.loc[may.any(axis=1), keep], b.loc[may.any(axis=0), keep]])


def _unit_edges(unit: pd.DataFrame, num: int, den: int) -> pd.DataFrame | None:
    """One edge for each member of a unit that is linked with another part of the graph."""
    if (sides := _sides(unit, num, den)) is None:
        return None
    a, b, may = sides
    x, y = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    sets = lambda t, rows: [np.frombuffer(t["items"].iloc[int(k)], np.uint64) for k in rows]
    na, nb = a["n"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
    both = intersections(sets(a, x), sets(b, y))
    linked = may[np.ix_(x, y)] & (den * both >= num * (na[x][:, None] + nb[y] - both))
    rows, cols = np.nonzero(linked)
    if not len(rows):
        return None
    ends = lambda t, c, at: t[c].to_numpy()[at]
    edges = pd.DataFrame({"a": ends(a, "digest", x)[rows], "b": ends(b, "digest", y)[cols], "ca": ends(a, "comp", x)[rows], "cb": ends(b, "comp", y)[cols]})
    # Members of one part are connected already: an edge for each pair of parts will do, thinned to a forest.
    edges = edges.drop_duplicates(["ca", "cb"])
    parent: dict[bytes, bytes] = {}

    def root(v: bytes) -> bytes:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    keep = []
    for p, q in zip(edges["ca"], edges["cb"], strict=True):
        p, q = root(p), root(q)
        keep.append(p != q)
        parent[p] = q
    return edges.loc[keep, ["a", "b"]]


def _units(of, num: int, den: int):
    """What ``of`` makes of each unit; rows are sorted by unit (key, x, y), and one may span batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key, x, y = (pdf[c].to_numpy() for c in ("key", "x", "y"))
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist(), len(pdf)]
            if held and (held[0]["key"].iloc[0], held[0]["x"].iloc[0], held[0]["y"].iloc[0]) != (key[0], x[0], y[0]):
                if (got := of(pd.concat(held), num, den)) is not None:
                    yield got
                held = []
            for s, e in pairwise(cuts):
                part = pdf.iloc[s:e]
                if e == len(pdf):
                    held.append(part)
                else:
                    if (got := of(pd.concat([*held, part]) if held else part, num, den)) is not None:
                        yield got
                    held = []
        if held and (got := of(pd.concat(held), num, den)) is not None:
            yield got
        held.clear()
        give_back()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Rows are linked when den * |A n B| >= num * |A u B|. component_id is the
    smallest id reachable over links; kept is id = component_id. Nulls and
    texts without words have an empty set and are linked with nothing; texts
    of fewer words than a shingle have their whole sequence as one; texts of
    any length are handled whole; a null id keeps its row with a null
    component_id and kept true; rows that repeat an id share a component,
    whatever their texts; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sig = materialise(
        plain.mapInPandas(_signatures(shingle), "id long, n long, digest binary, sketch binary, keys array<long>"), "sig"
    )
    named = sig.where("id is not null and n > 0")
    alike = [F.first(c).alias(c) for c in ("n", "sketch", "keys")]  # equal sets have equal ones
    classes = materialise(named.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"), *alike), "classes")
    # Written before they are joined, so that a bucket of many rows can be split there.
    banded = materialise(classes.select("digest", F.explode("keys").alias("key")), "banded")
    full = materialise(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "full")
    met = materialise(banded.join(full, "key").select("key", "digest", "m"), "met")
    degree = materialise(met.groupBy("digest").agg(F.sum("m").alias("degree")), "degree")
    central = F.max_by("digest", F.struct("degree", "digest")).alias("leader")
    members = materialise(met.join(degree, "digest").select("key", "digest", "m", "degree"), "members")
    leaders = materialise(members.groupBy("key").agg(central), "leaders")
    active = materialise(members.join(leaders, "key").where("digest <> leader").select("key", "digest", "m", "leader"), "active")
    near = materialise(classes.join(degree, "digest", "left_semi").select("digest", F.col("n").cast("double").alias("n"), "sketch"), "near")
    for t in (banded, full, met, members, leaders, degree):
        discard(t)

    def with_sets(wanted: DataFrame) -> DataFrame:
        """(digest, items) of some classes, made from their texts again."""
        ids = materialise(wanted.distinct().join(classes.select("digest", "rep"), "digest"), "ids")
        texts = plain.withColumnRenamed("id", "rep").join(F.broadcast(ids) if ids.count() * 40 <= BROADCAST_BYTES else ids, "rep")
        made = texts.select("digest", "text").distinct().mapInPandas(_sets(shingle), "digest binary, items binary")
        sets = materialise(made, "sets")
        discard(ids)
        return sets

    # The star: every member against the centre of each of its buckets.
    left = near.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = near.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    pairs = active.select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct()
    sized = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    likely = materialise(
        sized.join(left.select("a", "sa"), "a").join(right.select("b", "sb"), "b").mapInPandas(_likely(num / den), "a binary, b binary"), "likely"
    )
    sets = with_sets(likely.select(F.col("a").alias("digest")).union(likely.select("b")))
    star = materialise(
        likely.join(sets.select(F.col("digest").alias("a"), F.col("items").alias("xa")), "a")
        .join(sets.select(F.col("digest").alias("b"), F.col("items").alias("xb")), "b")
        .mapInPandas(_verified(num, den), "a binary, b binary")
        .unionByName(same_id(named)),
        "links",
    )
    labels = connected_components(star, "a", "b")
    for t in (sets, likely):
        discard(t)

    # What the star leaves apart: in each bucket, members outside its largest part meet all others but the centre.
    rest = materialise(
        active.where("m > 2").join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("comp")), "rest"
    )
    parts = rest.groupBy("key", "comp").agg(F.count("*").alias("c"))
    torn = parts.groupBy("key").agg(F.max_by(F.struct("comp", "c"), F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda x: F.ceil(x / F.lit(BLOCK)).cast("int")
    torn = materialise(torn.select("key", F.col("main.comp").alias("main"), blocks(F.col("main.c")).alias("mains"), blocks(F.col("all") - F.col("main.c")).alias("others")), "torn")
    placed = rest.join(torn, "key").withColumn("outside", F.col("comp") != F.col("main"))
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(digest), if(outside, others, mains)) as int)"))
    # Unit (x, y): block x outside against main block y, or against block y - mains outside, x or a later one.
    units = F.expr(
        "if(outside,"
        " concat(transform(sequence(0, mains + others - 1), y -> struct(block as x, y as y, 0 as side)),"
        "  transform(sequence(0, block), x -> struct(x as x, mains + block as y, 1 as side))),"
        " transform(sequence(0, others - 1), x -> struct(x as x, block as y, 1 as side)))"
    )
    # Of units within the outside, those with y - mains below x are the same pairs again, and the diagonal needs its rows once.
    dealt = placed.select("key", "digest", "comp", "mains", F.explode(units).alias("u")).select("key", "digest", "comp", "mains", "u.*")
    dealt = dealt.where("y < mains or y - mains > x or (y - mains = x and side = 0)").drop("mains")
    together = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    sketched = dealt.join(near.withColumn("n", F.col("n").cast("long")), "digest").select("key", "x", "y", "side", "digest", "comp", "n", "sketch")
    alive = materialise(
        together(sketched).mapInPandas(_units(_unit_survivors, num, den), "key long, x int, y int, side int, digest binary, comp binary, n long"), "alive"
    )
    if not alive.isEmpty():
        sets = with_sets(alive.select("digest"))
        more = materialise(together(alive.join(sets, "digest")).mapInPandas(_units(_unit_edges, num, den), "a binary, b binary"), "links")
        if not more.isEmpty():
            discard(labels)
            labels = connected_components(star.unionByName(more), "a", "b")
        discard(sets)
    for t in (alive, torn, rest, active, near):
        discard(t)

    # Ids: the smallest of each component, for every class.
    linked = labels.withColumnRenamed("node", "digest").join(classes.select("digest", "rep"), "digest")
    found = linked.select("digest", "component").join(linked.groupBy("component").agg(F.min("rep").alias("least")), "component")
    of_class = classes.select("digest", "rep", "size").join(found, "digest", "left").select("digest", "size", F.coalesce("least", "rep").alias("least"))
    of_class = materialise(of_class, "named")
    # Classes of at least a thousandth of all rows, a thousand at most, are broadcast; the others meet their rows by digest.
    large = F.col("size") * HOT_SHARE >= max(1, sig.count())
    hot = F.broadcast(of_class.where(large).select("digest", F.col("least").alias("known")))
    rows = sig.select("id", "n", "digest")
    here = rows.where("id is not null and n > 0").join(hot, "digest", "left")
    alone = rows.where("id is null or n = 0").withColumn("least", F.col("id"))
    common = here.where("known is not null").withColumnRenamed("known", "least")
    rare = here.where("known is null").drop("known").join(of_class.where(~large).select("digest", "least"), "digest")
    every = alone.select("id", "n", "least").unionByName(common.select("id", "n", "least")).unionByName(rare.select("id", "n", "least"))
    return every.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("least").alias("component_id"),
        F.coalesce(F.col("id") == F.col("least"), F.lit(True)).alias("kept"),
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, with all their columns, but for those that another row of their group stands for.

    Rows with a null id, a null text or a text without words stay; of rows
    that repeat an id all stay or all go; columns may have any names; an empty
    table gives an empty one. The ids that go are broadcast while they are
    measured to be few; otherwise both sides shuffle.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    name = unused(docs.columns, "gone")
    gone = materialise(found.where(~F.col("kept")).select(F.col(f"`{id_col}`").alias(name)).distinct(), "gone")
    few = gone.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
