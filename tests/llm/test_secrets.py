import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import secrets as S
from weft.llm.queries import op10_secret_scan

CASE = "".join
ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def check(got, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    want = []
    for i, t in docs:
        b = brute(t)
        want.append((i, *[sum(x[0] == k for x in b) for k in S.KINDS], hashlib.sha256(S.joined(b).encode()).hexdigest(), b))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert {f"{k}:{a}:{b}" for k, a, b in w[5]} == {s for s in g.spans.split(",") if s and ">" not in s}


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sum(bool(brute(t)) for _, t in docs) > 3
    check(op10_secret_scan(spark, sf_dir).collect(), docs)


def test_edge_rows_and_empty(spark, edge, empty):
    check(S.secret_spans(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert S.secret_spans(empty).count() == 0 and S.redact_secrets(empty).count() == 0
    redacted = S.redact_secrets(edge)
    assert redacted.columns == edge.columns and redacted.count() == edge.count()
    assert not any(brute(r.text) for r in redacted.collect())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdefAKI0123456789XYZ:= \"'_-.tokensrphwdiyſK%\\u", max_size=80))
def test_base_kinds_on_random_texts(text):
    assert sorted(S.base_spans(text)) == sorted(brute(text))


def test_nested_layers_map_to_the_original():
    secret = "password=hunter2hunter2"
    b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    quote = lambda s: urllib.parse.quote(s, safe="")
    layers = {
        "base64>assign": b64(secret), "url>assign": quote(secret), "unicode>assign": "\\u0070assword=hunter2hunter2", "base64>base64>assign": b64(b64(secret)),
        "base64>zlib>assign": b64(zlib.compress(secret.encode())), "base64>gzip>assign": b64(gzip.compress(secret.encode(), mtime=0)), "url>url>assign": quote(quote(secret)),
        "base64>url>assign": b64(quote(secret)), "unicode>url>assign": "pass\\u0025" + quote("word=hunter2hunter2")[0:0] + "77ord%3Dhunter2hunter2", "base64>zlib>base64>assign": b64(zlib.compress(b64(secret).encode())),
    }
    for kind, inner in layers.items():
        text = f"é🙂 before {inner} after"
        spans = [x for x in S.all_spans(text) if x[0] == kind]
        assert spans, kind
        (_, a, b) = spans[0]
        assert text.index(inner) <= a < b <= text.index(inner) + len(inner)
        assert secret not in S.redacted(text, S.all_spans(text))


def test_worklist_ends():
    assert S.all_spans("%25" * 50) == []
    S.all_spans(base64.b64encode(zlib.compress(b"a" * 1_000_000)).decode())
    assert S.redacted("abc", [("x", 0, 2), ("y", 1, 3)]) == "[SECRET]"


def encoded(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def kinds(text):
    return {k for k, _, _ in S.all_spans(text)}


def test_base64_of_short_lines():
    for end in ("\n", "\r\n", "\t"):
        inner = encoded(end.join(["a: 1", "b: 2", "c: 3", "d: 4", "e: 5", "f: 6", "password=hunter2hunter2"]))
        assert "base64>assign" in kinds(f"see {inner} there")
        assert "hunter2" not in S.redacted(inner, S.all_spans(inner)) and "[SECRET]" in S.redacted(inner, S.all_spans(inner))


def test_readable_stretches_of_mixed_layers():
    line, noise = "password=hunter2hunter2", b"\0\xe9\xff\x07\x80"
    for kind, text in {
        "url>assign": "?name=Jos%E9&password%3Dhunter2hunter2&x=%00", "base64>assign": encoded(b"text " * 99 + noise + line.encode() + noise), "base64>gzip>assign": encoded(gzip.compress(noise + line.encode() + noise, mtime=0)),
        "base64>url>assign": encoded(noise + b" %FFpassword%3Dhunter2hunter2 " + noise),
    }.items():
        assert kind in kinds(text), kind
        assert "hunter2" not in S.redacted(text, S.all_spans(text))
    text = "é🙂 " + encoded(noise + b"ab " + line.encode() + b" cd")
    (a, b), skip = next((a, b) for k, a, b in S.all_spans(text) if k == "base64>assign"), len(noise) + 3
    assert (a, b) == (3 + 4 * skip // 3, 3 + -(-4 * (skip + len(line)) // 3))


def test_url_runs_in_linear_time():
    assert S.all_spans("x" * 300_000 + "% " + "y" * 300_000 + "%4z") == []
    assert kinds("z" * 300_000 + "&password%3Dhunter2hunter2") == {"url>assign"}


def test_compressed_layers_are_scanned_whole():
    line, far = "\npassword=hunter2hunter2\n", b"lorem ipsum dolor\n" * 1_000_000
    members = gzip.compress(b"first", mtime=0) + gzip.compress(line.encode(), mtime=0)
    for kind, data in {
        "base64>gzip>assign": members, "base64>zlib>assign": zlib.compress(far + line.encode()), "base64>gzip>gzip>assign": gzip.compress(gzip.compress(far + line.encode(), mtime=0), mtime=0),
        "base64>gzip>base64>assign": gzip.compress(b"\0" * (17 << 20) + encoded("x" * 2_000_000 + line).encode() + b"\0" * (17 << 20), mtime=0),
    }.items():
        assert kind in kinds(encoded(data)), kind
    split = line.encode() + b"a" * ((16 << 20) - len(line) - 1) + "é".encode()
    assert "base64>zlib>assign" in kinds(encoded(zlib.compress(split)))


def test_windows_lose_nothing(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 64)
    text = "\n".join(f"é {k} password = 'hunter{k}hunter' and {encoded(f'token={k:06d}')} {k}é" for k in range(200))
    chunks = [text.encode()[k : k + 7] for k in range(0, len(text.encode()), 7)]
    windows = list(S._windows(iter(chunks)))
    assert "".join(windows) == text and len(windows) > 50
    assert sum(len(S.base_spans(w)) for w in windows) == 200 and sum(len(S.RUN.findall(w)) for w in windows) == len(S.RUN.findall(text))


def test_base64_anywhere_in_a_run_and_wrapped():
    line = "password=hunter2hunter2"
    wrap = lambda s, n, end: end.join(s[k : k + n] for k in range(0, len(s), n))
    for data, kind in ((line, "base64>assign"), (gzip.compress(line.encode(), mtime=0), "base64>gzip>assign"), *((zlib.compress(line.encode(), n), "base64>zlib>assign") for n in (1, 5, 6, 9))):
        for before in ("data-", "x/", "_", "ab_c/d-", "key: "):
            text = before + encoded(data)
            assert kind in kinds(text), text
            assert "hunter2" not in S.redacted(text, S.all_spans(text)) and S.redacted(text, S.all_spans(text)) != text
    noise = b"".join(hashlib.sha256(bytes([k])).digest() for k in range(20))
    for inner, kind in ((b"lorem ipsum " * 6 + line.encode(), "base64>assign"), (gzip.compress(noise + line.encode(), mtime=0), "base64>gzip>assign"), (encoded(noise + line.encode()).encode(), "base64>base64>assign")):
        for n in (20, 64, 76):
            for end in ("\n", "\r\n", "\n    "):
                for before in ("", "é key: ", "-----BEGIN DATA-----\n", "see data-"):
                    text = f"{before}{wrap(encoded(inner), n, end)}\n\nafter"
                    assert kind in kinds(text), (kind, n, end, before)
    inner = "lorem ipsum dolor sit amet consectetur " + line
    text = "é🙂 " + wrap(encoded(inner), 64, "\n")
    a, b = next((a, b) for k, a, b in S.all_spans(text) if k == "base64>assign")
    assert base64.b64decode(text[3:].replace("\n", "")).decode() == inner and "\n" in text[a:b] and b <= len(text)
    low = 4 * inner.index(line) // 3
    assert a == 3 + low + text[3 : 3 + low].count("\n")


CODERS = {
    "url": lambda s: "".join(f"%{b:02X}" if not chr(b).isalnum() or b % 3 == 0 else chr(b) for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": encoded,
    "zlib": lambda s: encoded(zlib.compress(s.encode())),
    "gzip": lambda s: encoded(gzip.compress(s.encode(), mtime=0)),
}


def decodings(token):
    """What a token decodes to, by the standard library's decoders."""
    yield urllib.parse.unquote(token)
    yield re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), token)
    for cut in range(min(4, len(token))):
        run = re.match("[A-Za-z0-9+/]*", token[cut:])[0]
        try:
            data = base64.b64decode(run[: len(run) // 4 * 4] if len(run) % 4 == 1 else run + "=" * (-len(run) % 4))
        except ValueError:
            continue
        yield data.decode("utf-8", "replace")
        for wbits in (15, 31):
            try:
                yield zlib.decompressobj(wbits).decompress(data).decode("utf-8", "replace")
            except zlib.error:
                pass


def reachable(text, secret, depth=6):
    """Whether the secret turns up when tokens are decoded again and again."""
    todo, seen = {text}, set()
    for _ in range(depth):
        if any(secret in t for t in todo):
            return True
        seen |= todo
        todo = {d for t in todo for token in t.split() for d in decodings(token)} - seen
    return False


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(sorted(CODERS)), min_size=1, max_size=4), st.sampled_from(["password=", "api_key: '", "TOKEN = \"", "id AKIA"]))
def test_generated_nestings_against_the_standard_decoders(chain, start):
    secret = "QX7" + "ABCDEFGH" * 3 + "45"
    inner = start + secret
    for name in chain:
        inner = CODERS[name](inner)
    text = f"Größe: {inner} end"
    assert reachable(text, secret)
    spans = S.all_spans(text)
    lo, hi = text.index(inner), text.index(inner) + len(inner)
    assert any(">" in k and lo <= a < b <= hi for k, a, b in spans), (chain, spans)
    assert not reachable(S.redacted(text, spans), secret), chain
