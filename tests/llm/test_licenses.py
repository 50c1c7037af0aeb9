import math
import re

import pytest

from weft.llm import licenses as L
from weft.llm.queries import op3_license_scan


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(rows):
    docs = [(i, words(t)) for i, t in rows]
    vocab = L.vocabulary()
    df = {v: sum(v in set(w) for _, w in docs) for v in vocab}
    idf = {v: math.log((len(docs) + 1) / (df[v] + 1)) + 1e-6 for v in vocab}
    out = []
    for i, w in docs:
        at = sorted(k for p in L.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        base = {label for p, label in L.BASE.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
        best, labels = 0.0, set(base)
        if set(w) & set(L.ANCHORS):
            for label, key, text in L.TEMPLATES:
                t, k = text.split(), key.split()
                kp = next(x for x in range(len(t)) if t[x : x + len(k)] == k)
                for a in range(-len(t), len(w)) if set(k) <= set(w) else ():
                    here = [0 <= a + p < len(w) and w[a + p] == t[p] for p in range(len(t))]
                    score = sum(idf[v] for v, h in zip(t, here, strict=True) if h) / sum(idf[v] for v in t)
                    if all(here[kp : kp + len(k)]) and score >= L.LEAST:
                        labels.add(label)
                        best = max(best, score)
        out.append((i, len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, best)))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:7]) == tuple(w[:7])
        assert g[7] == pytest.approx(w[7], abs=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(r[2] > 0 for r in want) > 2
    compare(op3_license_scan(spark, sf_dir).collect(), want)


def test_edge_rows_and_empty(spark, edge, empty):
    compare(L.license_scan(edge).collect(), brute([(r.doc_id, r.text) for r in edge.collect()]))
    assert L.license_scan(empty).count() == 0


def test_templates(spark):
    texts = [t.upper().replace(" ", ", ") for _, _, t in L.TEMPLATES] + ["CC BY-NC-SA", "see the MIT licensed", "MIT License MIT License", "cc0 1 0 universal"]
    rows = list(enumerate(texts))
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compare(got, brute(rows))
    assert all(set(p.split()) & set(L.ANCHORS) for p in [*L.BASE, *(k for _, k, _ in L.TEMPLATES)])
    for r, (label, _, _) in zip(sorted(got), L.TEMPLATES, strict=False):
        assert label in r.labels.split(",") and r.score > 0.99


def test_every_template_is_tried(spark):
    prose = "any charge copy source affero documentation mozilla eclipse unencumbered attribution "
    pairs = [f"{a}. {b}" for la, _, a in L.TEMPLATES for lb, _, b in L.TEMPLATES if la != lb]
    rows = list(enumerate(pairs + [prose * 50 + t for _, _, t in L.TEMPLATES]))
    want = brute(rows)
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compare(got, want)
    expect = [{la, lb} for la, _, _ in L.TEMPLATES for lb, _, _ in L.TEMPLATES if la != lb] + [{label} for label, _, _ in L.TEMPLATES]
    for r, labels in zip(sorted(got), expect, strict=True):
        assert labels <= set(r.labels.split(",")) and r.score > 0.99


def test_long_texts_of_one_word(spark):
    rows = [(0, "license " * 20_000), (1, "permission is hereby granted free of charge " * 3_000), (2, "cc by " * 9_000)]
    got = sorted(L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r.n_words, r.n_base, r.labels) for r in got] == [(20_000, 0, ""), (21_000, 0, ""), (18_000, 9_000, "cc-by")]


def test_capitals_outside_ascii(spark):
    rows = [(0, "this wor\u212a is licensed under the gnu general public license version 3"), (1, "M\u0130T License m\u0130t license"), (2, "THIS WORK is licensed UNDER the gnu general public license version 3")]
    compare(L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))
