import hashlib
import tarfile
import zlib

import pytest

from weft.llm import media as M
from weft.llm.queries import op2_media_columns


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw)), len(raw)


def check(rows, docs):
    assert len(rows) == len(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(i, len((t or "").encode()), t) for i, t in docs], key=key)
    for r, (i, n, t) in zip(sorted(((r.doc_id, r.n_bytes, r) for r in rows), key=lambda x: key(x[:2])), want, strict=True):
        data, size = padded(t)
        got = r[2]
        assert (got.doc_id, got.n_bytes, got.payload_bytes) == (i, size, len(data)) and n == size
        assert got.payload_sha256 == hashlib.sha256(data).hexdigest() and got.tail_crc32 == zlib.crc32(data[-16:])
        media = M.encode(data)
        assert (got.media_bytes, got.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert got.feature == M.describe(data, got.width, got.height, got.depth) and (got.width, got.height, got.depth) == (192, len(data) // 192, 8)


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op2_media_columns(spark, sf_dir).collect(), docs)


def test_edge_rows_and_empty(spark, edge, empty):
    check(M.media_columns(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert M.media_columns(empty).count() == 0


def test_shards_are_tar_files_with_each_content_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(40)], "doc_id long, text string").coalesce(1)
    manifest, folder = M.store(docs, folder=f"file://{tmp_path}/media")
    rows = manifest.collect()
    (shard,) = {r.shard for r in rows}
    with tarfile.open(f"{tmp_path}/media/{shard}") as tar:
        names = {m.name: m for m in tar.getmembers()}
    assert len(names) == 5
    for r in rows:
        assert names[f"{bytes(r.digest).hex()}.png"].offset_data == r.offset and names[f"{bytes(r.digest).hex()}.png"].size == r.length
    heads = {bytes(r.digest): tuple(r)[1:] for r in M.metadata(manifest, folder).collect()}
    assert heads == {bytes(r.digest): (192, 1, 8) for r in rows}


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_round_trip(n):
    data, _ = M.payload("x" * n)
    assert M.decode(M.encode(data)) == data and len(data) % 192 == 0 and data


def test_addresses_are_those_of_the_stored_payload(spark, tmp_path):
    rows = [(1, "abc"), (2, "abc "), (3, "abc"), (4, None), (5, " " * 192), (6, "abc\n")]
    got = {r.doc_id: r for r in M.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 6 and all(r.digest == r.payload_sha256 for r in got.values())
    place = lambda k: (got[k].digest, got[k].shard, got[k].offset, got[k].length)
    assert place(1) == place(2) == place(3) != place(6) and place(4) == place(5)
    assert [got[k].n_bytes for k in range(1, 7)] == [3, 4, 3, 0, 192, 4]


def test_damaged_payloads_are_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc"), (2, "def")], "doc_id long, text string").coalesce(1)
    manifest, folder = M.store(docs, folder=f"file://{tmp_path}/media")
    swapped = {r.id: r for r in manifest.collect()}
    wrong = spark.createDataFrame([(swapped[1].digest, swapped[2].shard, swapped[2].offset, swapped[2].length, 1)], "digest binary, shard string, offset long, length long, size long")
    with pytest.raises(Exception, match="not the content of"):
        wrong.mapInPandas(M._read(folder), "digest binary, shard string, offset long, length long, size long, width long, height long, depth int, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string").collect()
