"""Media columns: content-addressed payloads in tar shards.

A payload (bytes, padded with spaces to whole rows of 192 samples) is stored
losslessly as an 8-bit greyscale PNG image, named by the digest of its
content (the padded payload), in a tar shard in the shared folder. Rows carry
digest, offset and length; what is read back must have the digest it is named
by. Metadata columns (width, height, depth) come from range reads of the
header alone; features come from reading the stored bytes back.

Each task writes shards of its own, under a name that holds its attempt, so a
task that runs again never touches what another wrote; only shards of
committed tasks are referred to. Within a shard a content is stored once, and
all rows with that content refer to one place of it, whichever shard they
came from.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import small_batches, with_class
from weft.storage import discard, materialise, new_path

WIDTH = 192
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: A shard is closed when it is this long.
SHARD_BYTES = 256 << 20
#: Stored bytes that are dealt out together, and that a task reads back.
RANGE_BYTES, TASK_BYTES = 1 << 20, 16 << 20


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, padded to a positive multiple of WIDTH, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """An 8-bit greyscale PNG, WIDTH samples a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode(media: bytes) -> bytes:
    """The samples of a PNG of encode()."""
    width, height, depth = read_header(media[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if depth != 8 or rows[:, 0].any():
        raise ValueError("not a PNG of this module")
    return rows[:, 1:].tobytes()


def describe(samples: bytes, width: int, height: int, depth: int) -> str:
    """Shape, mean, deviation and a 64-bit average hash over an 8 x 8 grid."""
    x = np.frombuffer(samples, np.uint8)
    cells = np.add.reduceat(x.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64), np.arange(0, WIDTH, WIDTH // 8))
    bands = [int(part.sum(dtype=np.int64)) / len(part) for part in np.array_split(x, 8)]
    grid = np.array(bands)[:, None] + cells[None, :] / (len(x) / 8)
    bits = (grid > grid.mean()).ravel()
    return f"{width}x{height}x{depth}:{x.mean():.3f}:{x.std():.3f}:{int(''.join('01'[int(b)] for b in bits), 2):016x}"


class Shard:
    """A tar file under construction, on any file system that pyarrow opens."""

    def __init__(self, folder: str, name: str):
        uri = f"{folder}/{name}"
        self.name, self.known, self.at = name, {}, 0
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)

    def add(self, digest: bytes, data: bytes) -> tuple[int, int]:
        """Where the data of a member stand: offset and length."""
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.known[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.known[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        number, shard = 0, None
        for pdf in small_batches(batches):
            out = []
            for text in pdf["text"]:
                if shard is not None and shard.at >= SHARD_BYTES:
                    shard.close()
                    shard = None
                if shard is None:
                    shard = Shard(folder, f"{task.partitionId()}-{task.taskAttemptId()}-{number}.tar")
                    number += 1
                data, n = payload(text)
                digest = hashlib.sha256(data).digest()
                at = shard.known.get(digest) or shard.add(digest, encode(data))
                out.append((digest, n, shard.name, *at))
            rows = pd.DataFrame(out, columns=["digest", "n_bytes", "shard", "offset", "length"])
            rows.insert(0, "id", pd.array(pdf["id"], "Int64"))
            yield rows
        if shard is not None:
            shard.close()

    return run


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, source = None, None
        for pdf in small_batches(batches):
            out = []
            for r in pdf.itertuples():
                if r.shard != name:
                    system, path = fs.FileSystem.from_uri(f"{folder}/{r.shard}")
                    name, source = r.shard, system.open_input_file(path)
                width, height, depth = read_header(source.read_at(HEADER_BYTES, r.offset))
                media = source.read_at(r.length, r.offset)
                samples = decode(media)
                if hashlib.sha256(samples).digest() != r.digest:
                    raise ValueError(f"not the content of {r.digest.hex()}: {r.shard} at {r.offset}")
                out.append(
                    (r.digest, r.shard, r.offset, r.length, r.size, width, height, depth, len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).digest(), describe(samples, width, height, depth))
                )
            yield pd.DataFrame(out, columns=["digest", "shard", "offset", "length", "size", "width", "height", "depth", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return run


def _heads(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small_batches(batches):
            out = []
            for name, own in pdf.groupby("shard", sort=False):
                system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                with system.open_input_file(path) as source:
                    out += [(d, *read_header(source.read_at(HEADER_BYTES, o))) for d, o in zip(own["digest"], own["offset"], strict=True)]
            yield pd.DataFrame(out, columns=["digest", "width", "height", "depth"])

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the texts' payloads to tar shards: (id, digest, n_bytes, shard, offset, length) for every row, and the shards' folder.

    folder: a URI that all executors share and pyarrow opens; by default one
    in the session's shared folder.
    """
    folder = folder or new_path(docs.sparkSession, "media")
    folder = f"file://{folder}" if folder.startswith("/") else folder
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    manifest = plain.mapInPandas(_write(folder), "id long, digest binary, n_bytes long, shard string, offset long, length long")
    return materialise(manifest, "manifest"), folder


def places(manifest: DataFrame) -> DataFrame:
    """(digest, shard, offset, length, size): one place of each content, and how many rows have it."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count("*").alias("size")).select("digest", "p.*", "size")


def dealt(places: DataFrame) -> DataFrame:
    """Places dealt out by ranges of the shards, in order of reading."""
    part = F.floor(F.col("offset") / RANGE_BYTES)
    # A number of our own: the rows are small, what they refer to is not.
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    return places.repartition(tasks, F.col("shard"), part).sortWithinPartitions("shard", "offset")


def metadata(manifest: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, depth) of each content, from header-only range reads."""
    return dealt(places(manifest)).mapInPandas(_heads(folder), "digest binary, width long, height long, depth int")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The rows of docs with digest, place, metadata and features of their stored payloads.

    Columns: id_col, digest, n_bytes, shard (a URI), offset, length, width,
    height, depth, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; digests in lowercase hex. Null texts are empty;
    empty payloads are one row of spaces; texts of any length are stored
    whole; null ids stay null; repeated rows and equal texts give equal
    values; texts that differ in spaces at their end within the padding share
    a payload; an empty table gives an empty result; other columns are
    ignored.
    """
    manifest, folder = store(docs, id_col, text_col, folder)
    one = materialise(places(manifest), "places")
    read = dealt(one).mapInPandas(
        _read(folder),
        "digest binary, shard string, offset long, length long, size long, width long, height long, depth int,"
        " payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string",
    )
    read = materialise(read, "features")
    discard(one)
    hexed = {c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")}
    found = with_class(manifest.select(F.col("id").alias(id_col), "digest", "n_bytes"), read, "digest", manifest.count())
    return found.withColumns(hexed | {"shard": F.concat(F.lit(f"{folder}/"), "shard")})
