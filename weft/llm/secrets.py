"""Secret scans with a recursive decoding worklist.

Every text is scanned for the base kinds as it stands. Then a worklist
unwraps what is nested in it: URL (%XX) and Unicode (\\uXXXX, \\xXX, &#N;)
escapes, base64 runs, and compressed data (zlib, gzip) inside base64. Each
layer is rescanned and searched for further layers until nothing new turns up;
a layer with the same content at the same place isn't taken twice, but for a
shorter way to it (cycle detection). Each layer knows which characters of the original text each of its
characters came from, so what is found deep inside is reported as a span of
the original text, as ``layers>kind``. A layer need not be text as a whole:
bytes that aren't UTF-8 and control characters stand between its readable
stretches.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import by_slices, small_batches

#: The base kinds and their patterns. Runs are maximal, so the least lengths can stand in the patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: One of these, in lower case, is in the lower case of every assign match.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Every access and hex match, and every base64 layer, is inside such a run.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")

#: From the first escape of a run without white space; what stands before it is looked for backwards, so that long runs take linear time.
URL = re.compile(r"(?:%[0-9A-Fa-f]{2}[^\s%]*+)++")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});")
NOT_HEX = re.compile(r"[^0-9a-f]")
#: Runs at the end of one line and the start of the next; base64 is often wrapped.
BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)+")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
#: How base64 of zlib and gzip data starts.
PACKED = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
#: Compressed layers are unpacked, and scanned, in windows of about so many bytes.
WINDOW = 1 << 20
#: Up to the last place where neither a pattern nor a run can go on, nor lines of base64 that belong together.
BREAK = re.compile(r"""(?s:.*)(?:[^A-Za-z0-9+/_.=\-"':;%\\&#\s]|(?<=[A-Za-z0-9.,;)])\x20(?=[A-Za-z(])|\n(?=[\x20\t]*[^A-Za-z0-9+/_=\s-]))""", re.ASCII)


class Layer(NamedTuple):
    text: str
    #: Original start and end of each character; None for the text itself and what has one origin as a whole.
    starts: list[int] | None
    ends: list[int] | None
    names: tuple[str, ...]
    whole: tuple[int, int] | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (a, b) if self.starts is None else (min(self.starts[a:b]), max(self.ends[a:b]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, leftmost and non-overlapping in each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for run in RUN.finditer(text):
        found += [("access", *m.span()) for m in ACCESS.finditer(text, *run.span())]
        found += [("hex", *m.span()) for m in HEX.finditer(text, *run.span())]
    return found


def _bytes(text: str) -> bytes:
    """UTF-8 of the text; what _utf8 couldn't decode gets its bytes back."""
    try:
        return text.encode("utf-8", "surrogateescape")
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass")


def _telling(text: str) -> bool:
    """Whether the text can have a base kind or a further layer."""
    low = text.lower()
    return any(w in low for w in WORDS) or any(p.search(text) for p in (RUN, URL, ESCAPE, BLOCK))


def _utf8(data: bytes, at: Callable[[int], tuple[int, int]]) -> tuple[str, list[int], list[int]] | None:
    """Text of the bytes with the origin of each character; None if nothing can be found in it.

    A byte that isn't UTF-8 becomes one surrogate, which no pattern takes, so
    the readable stretches around it keep their places. ``at`` gives the
    origin of a byte.
    """
    text = data.decode("utf-8", "surrogateescape")
    if not _telling(text):
        return None
    starts, ends, k = [], [], 0
    for c in text:
        n = len(_bytes(c))
        starts.append(at(k)[0])
        ends.append(at(k + n - 1)[1])
        k += n
    return text, starts, ends


def _url(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    done = 0
    for m in URL.finditer(layer.text):
        first = m.start()
        while first > done and layer.text[first - 1] != "%" and not layer.text[first - 1].isspace():
            first -= 1
        done = m.end()
        s, k, data, at = layer.text[first:done], 0, bytearray(), []
        while k < len(s):
            n = 3 if s[k] == "%" and re.fullmatch("[0-9A-Fa-f]{2}", s[k + 1 : k + 3]) else 1
            raw = bytes([int(s[k + 1 : k + 3], 16)]) if n == 3 else _bytes(s[k])
            data += raw
            if not layer.whole:
                at += [layer.span(first + k, first + k + n)] * len(raw)
            k += n
        if layer.whole:
            yield Layer(data.decode("utf-8", "surrogateescape"), None, None, (*layer.names, "url"), layer.whole)
        elif got := _utf8(bytes(data), at.__getitem__):
            yield Layer(*got, (*layer.names, "url"))


def _unicode(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    parts, starts, ends, at = [], [], [], 0

    def plain(upto: int) -> None:
        for k in range(at, 0 if layer.whole else upto):
            a, b = layer.span(k, k + 1)
            starts.append(a)
            ends.append(b)
        parts.append(layer.text[at:upto])

    for m in ESCAPE.finditer(layer.text):
        s = m[0]
        code = int(s[2:], 16) if s[0] == "\\" else int(s[3:-1], 16) if s[2] == "x" else int(s[2:-1])
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        plain(m.start())
        parts.append(chr(code))
        if not layer.whole:
            a, b = layer.span(*m.span())
            starts.append(a)
            ends.append(b)
        at = m.end()
    if parts:
        plain(len(layer.text))
        yield Layer("".join(parts), None if layer.whole else starts, None if layer.whole else ends, (*layer.names, "unicode"), layer.whole)


def _packed(head: bytes) -> str | None:
    """The kind of compressed data that starts so."""
    kind = "gzip" if head[:2] == b"\x1f\x8b" else "zlib" if head[:1] == b"\x78" and len(head) > 5 and int.from_bytes(head[:2], "big") % 31 == 0 else None
    if kind:
        try:
            zlib.decompressobj(47).decompress(head, 64)
        except zlib.error:
            return None
    return kind


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the chunks unpack to, member after member; from where they can't be unpacked, they come as they are."""
    unpack = zlib.decompressobj(47)
    for data in chunks:
        while data:
            try:
                out = unpack.decompress(data, WINDOW)
            except zlib.error:
                yield b"\n" + data
                yield from chunks
                return
            if out:
                yield out
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(47)
            else:
                data = unpack.unconsumed_tail
    if out := unpack.flush():
        yield out


def _unpacked(data: bytes) -> tuple[Iterator[bytes], list[str]]:
    """The bytes inside however many compressed layers, in chunks, and the kinds of these layers."""
    head, chunks, kinds = data, iter([data[k : k + (WINDOW >> 4)] for k in range(0, len(data), WINDOW >> 4)]), []
    while len(kinds) < 64 and (kind := _packed(head[:4096])):  # some data unpack to themselves
        kinds.append(kind)
        inner = _inflated(chunks)
        head = b""
        while len(head) < 4096 and (more := next(inner, None)) is not None:
            head += more
        chunks = chain([head], inner)
    return chunks, kinds


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    """Text of the chunks in windows that end where nothing can go on; longer ones where no such place comes."""
    decoder, parts, size = codecs.getincrementaldecoder("utf-8")("surrogateescape"), [], 0
    for data in chunks:
        text = decoder.decode(data)
        parts.append(text)
        size += len(text)
        if size >= WINDOW and (m := BREAK.match(text)):
            parts[-1] = text[: m.end()]
            yield "".join(parts)
            parts, size = [text[m.end() :]], len(text) - m.end()
    yield "".join(parts) + decoder.decode(b"", True)


def _runs(text: str) -> Iterator[tuple[str, list[range]]]:
    """Runs of base64 with the ranges they come from: those on one line, then those wrapped over lines of one width."""
    for m in RUN.finditer(text):
        yield m[0], [range(*m.span())]
    for m in BLOCK.finditer(text):
        pieces = [range(*p.span()) for p in PIECE.finditer(text, *m.span())]
        k = 0
        while k + 1 < len(pieces):  # what stands before the first full line may have any length
            first, k = k, k + 1
            width = len(pieces[k])
            while k + 1 < len(pieces) and len(pieces[k]) == width and len(pieces[k + 1]) <= width:
                k += 1
            lines = pieces[first : k + 1]
            if sum(map(len, lines)) >= 16:
                yield "".join(text[x.start : x.stop] for x in lines), lines


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _base64(layer: Layer) -> Iterator[Layer]:
    names = (*layer.names, "base64")
    for run, lines in _runs(layer.text):
        if not NOT_HEX.search(run):
            continue
        taken: set[int] = set()
        # Compressed data may start anywhere in a run, as after data- or x/.
        for m in PACKED.finditer(run):
            if not _packed(_decoded(run[m.start() : m.start() + 4096])):
                continue
            chunks, inner = _unpacked(_decoded(run[m.start() :]))
            whole = layer.span(_place(lines, m.start()), lines[-1].stop)
            taken.add(m.start())
            for text in _windows(chunks):
                if _telling(text):
                    yield Layer(text, None, None, (*names, *inner), whole)
        # Text may start anywhere too, so that each of the four phases reads to the end what starts in it.
        for phase in range(4):
            if phase in taken or len(run) - phase < 2:
                continue
            data = _decoded(run[phase:])
            if layer.whole:
                text = data.decode("utf-8", "surrogateescape")
                if _telling(text):
                    yield Layer(text, None, None, names, layer.whole)
                continue
            last = len(run) - 1

            def at(k: int, phase: int = phase, lines: list[range] = lines, last: int = last) -> tuple[int, int]:
                c = phase + 4 * (k // 3) + k % 3
                return layer.span(_place(lines, c), _place(lines, min(c + 1, last)) + 1)

            if got := _utf8(data, at):
                yield Layer(*got, names)


def _place(lines: list[range], k: int) -> int:
    """Where the character k of the lines, all but the first and the last of one width, stands."""
    if k < len(lines[0]):
        return lines[0][k]
    line, k = divmod(k - len(lines[0]), len(lines[1]))
    return lines[1 + line][k]


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    return (x for unwrap in (_url, _unicode, _base64) for x in unwrap(layer) if x.text != layer.text)


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans and those of the unwrapped layers, by start and then kind, base kinds first as listed."""
    found = base_spans(text)
    todo, more = [iter([Layer(text, None, None, ())])], set()
    seen: dict[tuple[bytes, tuple[int, int]], int] = {}  # the fewest steps that led there
    while todo:  # iterators of layers, the innermost last, so that one window of each compressed layer is held at a time
        if (layer := next(todo[-1], None)) is None:
            todo.pop()
            continue
        if layer.names:
            mark = (xxhash.xxh3_128_digest(layer.text.encode("utf-8", "surrogatepass")), layer.span(0, len(layer.text)))
            if seen.get(mark, len(layer.names) + 1) <= len(layer.names):
                continue
            seen[mark] = len(layer.names)
            for kind, a, b in base_spans(layer.text):
                more.add((kind, *layer.span(a, b), layer.names))
        todo.append(_unwrapped(layer))
    known = {(k, a, b) for k, a, b in found}
    own: dict[tuple[str, int, int], tuple[str, ...]] = {}
    for kind, a, b, names in sorted(more, key=lambda x: (len(x[3]), x)):
        if (kind, a, b) not in known:  # what stands there in the open as well is not reported again
            own.setdefault((kind, a, b), names)
    found = found + [(">".join((*names, k)), a, b) for (k, a, b), names in own.items()]
    rank = {k: n for n, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[1], rank.get(x[0], len(KINDS)), x[0], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced."""
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in small_batches(batches):
        out = []
        for text in pdf["text"]:
            spans = all_spans(text or "")
            base = [x for x in spans if x[0] in KINDS]
            count = [sum(x[0] == k for x in base) for k in KINDS]
            out.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        rows = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        rows.insert(0, "id", pd.array(pdf["id"], "Int64"))
        yield rows


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs.

    Spans are kind:start:end in code points of the original text, end
    exclusive. Null texts are empty and have no span; null ids stay null;
    repeated rows give equal rows; an empty table gives an empty result; other
    columns are ignored. Texts of any length are scanned whole.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = plain.mapInPandas(_scan, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)


def _redact(texts: list[str | None]) -> list[str | None]:
    return [redacted(t, found) if t is not None and (found := all_spans(t)) else t for t in texts]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret in text_col replaced.

    All rows and columns stay, whatever the others hold or are called; null
    texts stay null, empty ones empty; equal texts give equal ones; texts of
    any length are handled whole; an empty table gives an empty one.
    """
    return docs.withColumn(text_col, F.arrow_udf(by_slices(_redact, pa.string()), "string")(F.col(f"`{text_col}`").cast("string")))
