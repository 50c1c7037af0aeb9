"""DuckDB SQL of the queries that SQL can express: brute force over whole tables."""

from __future__ import annotations

from weft.llm import licenses as L

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From links(a, b) to comp(id, component).
_COMPONENTS = "both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links), walk AS (SELECT a, b FROM both_ways UNION SELECT w.a, x.b FROM walk w JOIN both_ways x ON w.b = x.a), comp AS (SELECT a AS id, least(a, min(b)) AS component FROM walk GROUP BY 1)"


def near_dedup(k: int = 2) -> str:
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, {shingle} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM docs WHERE len(w) >= {k})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND {k - 1}),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2) x
  JOIN sizes p ON p.doc_id = x.a JOIN sizes q ON q.doc_id = x.b WHERE 100 * c >= 80 * (p.n + q.n - c)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id"""


def near_vectors() -> str:
    return f"""WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.a = vec_id"""


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def license_scan() -> str:
    words = [(t, p, w) for t, (_, _, text) in enumerate(L.TEMPLATES) for p, w in enumerate(text.split())]
    books = []
    for t, (label, key, text) in enumerate(L.TEMPLATES):
        tw, kw = text.split(), key.split()
        at = next(k for k in range(len(tw)) if tw[k : k + len(kw)] == kw)
        books.append((t, label, at, at + len(kw) - 1))
    base = [(b, label, p, w, len(phrase.split())) for b, (phrase, label) in enumerate(L.BASE.items()) for p, w in enumerate(phrase.split())]
    anchors = ", ".join(f"'{w}'" for w in L.ANCHORS)
    return f"""WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
vocab(word) AS {_values((w,) for w in L.vocabulary())}, book(t, label, k0, k1) AS {_values(books)}, tpl(t, p, word) AS {_values(words)}, phrase(b, label, p, word, n) AS {_values(base)},
tok AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM docs),
lic AS MATERIALIZED (SELECT DISTINCT r, word FROM tok JOIN vocab USING (word)),
idf AS MATERIALIZED (SELECT v.word, ln(((SELECT count(*) FROM docs) + 1.0) / (count(lic.r) + 1)) + 1e-6 AS idf FROM vocab v LEFT JOIN lic USING (word) GROUP BY 1),
kept AS MATERIALIZED (SELECT DISTINCT r FROM lic WHERE word IN ({anchors})),
here AS MATERIALIZED (SELECT tok.* FROM tok JOIN kept USING (r)),
seed AS MATERIALIZED (
  SELECT t, p, word FROM tpl JOIN book USING (t) JOIN idf USING (word) WHERE p BETWEEN k0 AND k1 QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, word, p) = 1),
starts AS (SELECT r, t, pos - p AS a FROM here JOIN seed USING (word)),
judged AS (
  SELECT s.r, s.t, s.a, sum(CASE WHEN h.word = tpl.word THEN idf ELSE 0 END) / sum(idf) AS score, bool_and(coalesce(h.word = tpl.word, false)) FILTER (p BETWEEN k0 AND k1) AS key
  FROM starts s JOIN tpl USING (t) JOIN book USING (t) JOIN idf ON idf.word = tpl.word LEFT JOIN here h ON h.r = s.r AND h.pos = s.a + p GROUP BY 1, 2, 3),
found AS (SELECT r, label, score FROM judged JOIN book USING (t) WHERE key AND score >= {L.LEAST}),
places AS (SELECT r, b, label, pos - p AS a FROM here JOIN phrase USING (word) GROUP BY 1, 2, 3, 4 HAVING count(*) = max(n)),
base AS (SELECT r, count(*) AS n, min(a) AS lo, max(a) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM found) GROUP BY 1),
best AS (SELECT r, max(score) AS score FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, round(least(1.0, coalesce(score, 0)), 6) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)"""
