import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from weft.llm.bpe import bpe_documents
from weft.llm.queries import byte_vocabulary, op5_bpe

KINDS = ["ids_sha256", "decoded_sha256"]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(byte_vocabulary())


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_query_against_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op5_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, text = want(library, d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edge_rows(spark, edge, library):
    got = bpe_documents(edge, byte_vocabulary()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, len(x[1]))
    wanted = []
    for r in edge.collect():
        ids, text = want(library, r.text)
        wanted.append((r.doc_id, np.array(ids, "<u4").tobytes(), text))
    assert sorted([(r.doc_id, bytes(r.ids), r.decoded) for r in got], key=key) == sorted(wanted, key=key)


def test_empty(empty):
    assert bpe_documents(empty, byte_vocabulary()).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"STRETCH": 7, "RUN": 5, "LONG": 6, "COLUMNS": 3, "CACHE": 20}])
def test_random_strings(library, monkeypatch, bounds):
    from weft.llm import bpe

    for name, value in bounds.items():
        monkeypatch.setattr(bpe, name, value)
    with open(byte_vocabulary(), encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read())
    rng = np.random.default_rng(3)
    letters = list("aab  \n\t\0\xa0'stréñ日🙂09,.!-_ ​\x1c\x85ẞ") + ["'s", "'ll", "<|endoftext|>", "the ", " and"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 25)))
        ids, decoded = want(library, text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == decoded
