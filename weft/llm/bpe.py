"""Byte-level BPE encoding and decoding with a public vocabulary.

A pre-token's bytes become a doubly linked list of symbols and a priority
queue holds the rank of every adjacent pair that has a merge. The least rank
(leftmost on ties) is merged, its neighbours' new pairs are pushed, and
entries whose pair has changed meanwhile are skipped as stale: O(n log n) for
a pre-token of any length. Decoding concatenates the vocabulary's strings.

Texts are handled as runs of pieces (a word with the space before it). What a
run holds for the first time is merged together: the queues and lists of many
pre-tokens are rows of arrays and take a step each at a time; only pre-tokens
above LONG bytes have a heap of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import MIX, give_back

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers in each of two generations, none of them longer than so many characters.
CACHE, MEMORABLE = 200_000, 64
#: Bytes of a pre-token that is merged beside others of its length, in arrays of so many columns.
LONG, COLUMNS = 48, 1 << 12
#: Rows whose ids are held at a time.
SLICE = 256
#: Pieces that are encoded together, and characters of a text that are taken apart at a time.
RUN, STRETCH = 1 << 16, 1 << 18
#: No letters, numbers, apostrophes or space.
MARKS = ".,;:!?|#$%&*()"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Where a long text may be cut: no pre-token spans a single space or line end between other characters.
CUT = re.compile(r"(?<=\S)[ \n](?=\S)").search
#: White space other than single spaces and line ends between other characters; the null character marks pieces.
OTHER_SPACE, DOUBLE = re.compile(r"[^\S \n]|\0").search, ("  ", "\n\n", " \n", "\n ")


def odd(text: str, start: int) -> bool:
    """Whether the text can't be taken apart at its spaces and line ends; a cut may have left one at its start."""
    return text[start : start + 1].isspace() or text[-1:].isspace() or any(x in text for x in DOUBLE) or OTHER_SPACE(text) is not None


class Tokenizer:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        char = byte_characters()
        byte = {c: b for b, c in enumerate(char)}
        self.of_byte = [vocab[c] for c in char]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.first = np.array([self.rank.get(a << 20 | b, -1) for a in self.of_byte for b in self.of_byte], np.int64)  # of two bytes
        self.symbols, self.products = np.array(self.of_byte, np.int64), np.array(self.made, np.int64)
        self.slots, self.slot_rank = _table(np.array(list(self.rank), np.int64), np.array(list(self.rank.values()), np.int64))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in vocab.items():
            self.text[i] = bytes(byte[c] for c in text)
        for text, i in self.special.items():
            self.text[i] = text.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def pretokens(self, piece: str) -> list[str]:
        core = piece.rstrip(MARKS)
        if core.lstrip(" ").isalpha():  # letters, then marks: two pre-tokens at most
            return [core, piece[len(core) :]] if len(core) < len(piece) else [core]
        return self.words.findall(piece)

    def merged(self, data: bytes) -> list[int]:
        """Symbols of one pre-token, with a heap."""
        rank, made, of_byte, first = self.rank.get, self.made, self.of_byte, self.first
        sym = [of_byte[b] for b in data]
        n = len(sym)
        at = [int(first[a << 8 | b]) for a, b in pairwise(data)]  # the rank of the pair that starts at each symbol
        at.append(-1)
        heap = [r << 32 | i for i, r in enumerate(at) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if at[i] != r:
                continue  # stale: the pair has changed since it was pushed
            j = after[i]
            k = after[i] = after[j]
            new = sym[i] = made[r]
            sym[j] = at[j] = at[i] = -1
            if k < n:
                before[k] = i
                q = at[i] = rank(new << 20 | sym[k], -1)
                if q >= 0:
                    heappush(heap, q << 32 | i)
            p = before[i]
            if p >= 0:
                q = at[p] = rank(sym[p] << 20 | new, -1)
                if q >= 0:
                    heappush(heap, q << 32 | p)
        return [s for s in sym if s >= 0]

    def ranked(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 without a merge."""
        at = _slot(key, len(self.slots))
        found = self.slots[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            now = found[open_] = self.slots[at[open_]]
            open_ = open_[(now != key[open_]) & (now >= 0)]
        return np.where(found == key, self.slot_rank[at], -1)

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of about one length, as little-endian unsigned 32-bit integers.

        Their symbols are one array with links to the neighbours of the same
        pre-token; each has a queue of (rank, place) entries, a column, of
        which every step takes the least.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        end, ends = len(data), np.cumsum(n)  # the place at the end stands for what is beyond a pre-token
        place = np.arange(end)
        sym, at = np.append(self.symbols[data], -1), np.full(end + 1, -1)
        at[: end - 1] = self.first[data[:-1] << 8 | data[1:]]
        at[ends - 1] = -1
        after, before = np.append(place + 1, end), np.append(place - 1, end)
        after[ends - 1] = before[ends - n] = end
        none, low, size = np.iinfo(np.int64).max, (1 << 32) - 1, int(n.max())
        queue = np.full((2 * size, len(words)), none)
        row, column = place - np.repeat(ends - n, n), np.repeat(np.arange(len(words)), n)
        first = at[:end] >= 0
        queue[row[first], column[first]] = at[:end][first] << 32 | place[first]
        tail = np.full(len(words), size)
        while True:
            width = queue.shape[1]
            every, flat = np.arange(width), queue.reshape(-1)
            slot = queue.argmin(axis=0) * width + every
            entry = flat[slot]
            ended = entry == none
            over = int(ended.sum())
            if over == width:
                break
            if over * 4 > width:
                stay = ~ended
                queue, tail = np.ascontiguousarray(queue[:, stay]), tail[stay]
                continue
            flat[slot] = none
            i, r = np.minimum(entry & low, end), entry >> 32
            fresh = at[i] == r  # others are stale: their pair has changed
            c, i, r, slot = every[fresh], i[fresh], r[fresh], slot[fresh]
            j, p = after[i], before[i]
            k = after[j]
            new = self.products[r]
            after[i], before[k], sym[i] = k, i, new
            sym[j] = at[j] = -1
            left, right = sym[p], sym[k]
            q = self.ranked(np.concatenate([np.where(right < 0, -2, new << 20 | right), np.where(left < 0, -2, left << 20 | new)]))
            q, b = q[: len(i)], q[len(i) :]
            at[i], at[p] = q, b
            flat[slot] = np.where(q >= 0, q << 32 | i, none)
            some = b >= 0
            c, p, b = c[some], p[some], b[some]
            flat[tail[c] * width + c] = b << 32 | p
            tail[c] += 1
        there = sym[:end] >= 0
        upto = np.cumsum(np.add.reduceat(there, ends - n, dtype=np.int64)) * 4
        raw = sym[:end][there].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def all_merged(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of each pre-token."""
        raw = [x.encode("utf-8", "surrogatepass") for x in tokens]
        found: dict[str, bytes] = {}
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        for s in range(0, len(order), COLUMNS):
            some = [k for k in order[s : s + COLUMNS] if 0 < len(raw[k]) <= LONG]
            if some:
                found |= zip([tokens[k] for k in some], self.merged_together([raw[k] for k in some]), strict=True)
        for t, x in zip(tokens, raw, strict=True):
            if len(x) > LONG:
                found[t] = np.array(self.merged(x), "<u4").tobytes()
        return found

    def learned(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces that aren't known, which are then."""
        if len(self.known) > CACHE:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        found = {p: older[p] for p in pieces if p in older}
        found |= {p: np.array([self.special[p]], "<u4").tobytes() for p in pieces if p in self.special}
        new = {p: self.pretokens(p) for p in pieces if p not in found}
        found |= self.all_merged([t for t in dict.fromkeys(chain.from_iterable(new.values())) if t not in known and t not in found])
        for p, parts in new.items():
            if len(parts) > 1:
                found[p] = b"".join([found[t] if t in found else known[t] for t in parts])
        known.update((p, ids) for p, ids in found.items() if len(p) <= MEMORABLE)
        return found

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text in pieces that are encoded each by itself, a bounded list of them at a time."""
        for part in self.split(text):
            if part in self.special:
                yield [part]
                continue
            at = 0
            while at < len(part):
                cut = CUT(part, at + STRETCH) if len(part) - at > STRETCH else None
                some = part[at : cut.start()] if cut else part[at:]
                if odd(some, at > 0):
                    tokens = (m[0] for m in self.words.finditer(some))
                    while own := list(islice(tokens, RUN)):
                        yield own
                else:
                    yield some.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
                at += len(some)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        run: list[str] = []
        sizes: list[tuple[int, int]] = []  # (text, its pieces in the run)

        def flush() -> None:
            ids = list(map(self.known.get, run))
            if None in ids:
                found = self.learned(list(dict.fromkeys([p for p, x in zip(run, ids, strict=True) if x is None])))
                ids = [found[p] if x is None else x for p, x in zip(run, ids, strict=True)]
            at = 0
            for text, n in sizes:
                out[text].append(b"".join(ids[at : at + n]))
                at += n
            run.clear()
            sizes.clear()

        for k, text in enumerate(texts):
            for some in self.pieces(text):
                run += some
                sizes.append((k, len(some)))
                if len(run) >= RUN:
                    flush()
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return (key.astype(np.uint64) * MIX >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table, at most a quarter full: keys (-1 where free) and values; a taken slot leads to the next one."""
    size = 1 << max(4, (len(keys) * 4).bit_length())
    slots, held, left = np.full(size, -1), np.zeros(size, np.int64), np.arange(len(keys))
    at = _slot(keys, size)
    while len(left):
        free = left[slots[at[left]] < 0]
        slots[at[free]] = keys[free]  # of several, the last stays
        left = left[slots[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & (size - 1)
    _, order = np.unique(at, return_index=True)
    held[at[order]] = values[order]
    return slots, held


_made: dict[int, Tokenizer] = {}


def shared_tokenizer(spec: str) -> Tokenizer:
    """The worker's tokenizer of this vocabulary, made once."""
    key = hash(spec)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizer(spec)
    return _made[key]


def _coder(spec, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared_tokenizer(spec.value)
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                part = batch.slice(k, SLICE)
                ids = t.encode_all([x or "" for x in part.column("text").to_pylist()])
                columns = [part.column("id"), pa.array(ids, pa.binary()), pa.array([t.decode(np.frombuffer(x, "<u4").tolist()) if decode else None for x in ids], pa.string())]
                columns += part.columns[2:]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded", *part.schema.names[2:]])
        give_back()

    return run


def bpe_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, ids, decoded, *keep): token ids as little-endian unsigned 32-bit integers, the text they decode to, and columns of docs.

    vocabulary: path of a tokenizers JSON file with a byte-level BPE model; it
    is read once by the driver and broadcast (a vocabulary's size is fixed).
    Special tokens' strings in a text become their ids. Null and empty texts
    have no ids and decode to ""; texts of any length are encoded whole; of
    pairs with equal rank the leftmost merges first; null ids stay null; every
    row gives a row, equal texts equal ids; an empty table gives an empty
    result; other columns are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    more = [F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)]
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[2:])
    coded = plain.mapInArrow(_coder(spec, decode), "id long, ids binary, decoded string" + kinds)
    return coded.select(F.col("id").alias(id_col), "ids", "decoded", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])
