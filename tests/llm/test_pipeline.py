"""Each stage of the pipeline against a brute-force version, on its own input."""

import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

import corpus_pipeline as P
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_secrets import brute as base_spans
from weft.llm.mixing import targets
from weft.llm.queries import byte_vocabulary
from weft.llm.toxicity import toxicity_scores
from weft.storage import materialise


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for _, stage in P.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        tables.append(docs)
    return tables


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_schema(staged):
    for df in staged[1:-1]:
        assert df.dtypes == staged[0].dtypes


def test_toxicity(spark, sf_dir, staged):
    scores = toxicity_scores(staged[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in scores.where("score < 0.7").collect()}
    assert {r[0] for r in rows(staged[1], "doc_id")} == want and len(rows(staged[1], "doc_id")) == len(want)


def test_near_dedup(staged):
    want = {r[0] for r in groups(rows(staged[1], "doc_id", "text"), 5) if r[3]}
    assert sorted(r[0] for r in rows(staged[2], "doc_id")) == sorted(want)


def test_secrets(staged):
    before, after = dict(rows(staged[2], "doc_id", "text")), dict(rows(staged[3], "doc_id", "text"))
    assert before.keys() == after.keys()
    for i, text in before.items():
        found = base_spans(text)
        assert not base_spans(after[i])
        if not found:
            assert after[i] == text or "[SECRET]" in after[i]
        for _, a, b in found:
            assert text[a:b] not in after[i]
    assert all(n == len(t) for n, t in rows(staged[3], "n_chars", "text"))


def test_mixing(staged):
    docs = rows(staged[3], "doc_id", "text", "source")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    taken = Counter(r[0] for r in rows(staged[4], "doc_id"))
    assert max(taken.values()) <= 2 and {r for r in rows(staged[4], "doc_id", "text", "source")} <= set(docs)
    names = sorted({s for _, _, s in docs})
    sizes = [sum(size[i] for i, _, s in docs if s == n) for n in names]
    for n, goal in zip(names, targets(sizes), strict=True):
        own = [i for i, _, s in docs if s == n]
        assert abs(sum(size[i] * taken[i] for i in own) - goal) <= max(size[i] for i in own) / 2 + 1


def test_bpe(staged):
    library = Library.from_file(byte_vocabulary())
    texts = dict(rows(staged[4], "doc_id", "text"))
    out = rows(staged[5], "doc_id", "n_tokens", "ids", "decoded")
    assert Counter(r[0] for r in out) == Counter(r[0] for r in rows(staged[4], "doc_id"))
    for i, n, ids, decoded in out:
        want = library.encode(texts[i], add_special_tokens=False).ids
        assert np.frombuffer(bytes(ids), "<u4").tolist() == want and n == len(want) and decoded == texts[i]


def test_run_gives_the_last_stage(spark, sf_dir, staged):
    assert Counter(rows(P.run(spark, sf_dir), "doc_id", "n_tokens")) == Counter(rows(staged[5], "doc_id", "n_tokens"))


def test_odd_rows(spark, edge, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs, some in ((edge, True), (empty, False)):
        for _, stage in P.STAGES:
            docs = materialise(stage(spark, docs, str(tmp_path)), "odd")
        assert (docs.count() > 0) == some
