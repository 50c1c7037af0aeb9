"""License scans with a positional rare-token index, in DataFrame functions alone.

The document frequency of every word of the licence templates is counted over
all rows. The index holds, for each template, a posting (template, position)
of the word of highest IDF in its mandatory key phrase. Every such word of a
file is looked up; at place i of the file, with position p in a template, it
proposes that the template starts at i - p. No template that counts goes
unproposed, as its key phrase has to stand in its place. Proposals are
intersected with the template's other words by their relative position: the
share of the template's IDF weight that stands in its place is the score. A
template counts when its key phrase stands whole in its place and the score
reaches the threshold.

Texts are read once. What follows works on a written table of each row's
licence words, and on the words of rows that hold a key phrase's rarest word;
no row meets another except to count document frequencies.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.storage import materialise

#: Words, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, mandatory key phrase, template with the key phrase in it): sentences and passages of public licences.
TEMPLATES: list[tuple[str, str, str]] = [tuple(line.split("\t")) for line in (Path(__file__).parent / "license_templates.tsv").read_text(encoding="utf-8").splitlines()]
#: One word of each base or key phrase; a row without any of them has no phrase.
ANCHORS = ("license", "cc", "commons", "cc0", "redistribution", "redistributions", "permission", "unencumbered", "liable", "mpl", "compile", "neighboring")
#: The least score of a template that counts.
LEAST = 0.6
#: Letters outside ASCII with a lower case in it; others of their kind stand in, so that A-Z alone are lower-cased.
ODD_CAPITALS = {"\u212a": "\u0138", "\u0130": "\u0131"}


def vocabulary() -> list[str]:
    return sorted({w for _, _, t in TEMPLATES for w in t.split()} | {w for p in BASE for w in p.split()} | set(ANCHORS))


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _const(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase, words from 0."""
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words, i) == first
        for k, w in enumerate(rest, 1):
            found = found & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    n_base counts all places of base phrases, first_word and last_word are
    their smallest and largest start (null without any), base_labels and
    labels are distinct, sorted and comma-joined ("" without any), score is
    that of the best template that counts, else 0. Null texts are empty; texts
    of any length are read whole, in time linear in their words; null ids stay
    null; repeated rows give equal rows; an empty table gives an empty result;
    other columns are ignored.
    """
    vocab = vocabulary()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    for capital, letter in ODD_CAPITALS.items():
        text = F.replace(text, F.lit(capital), F.lit(letter))
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    tokens = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), words.alias("w"))
    known = tokens.select("id", "w", F.array_intersect(_array(vocab), "w").alias("lic"))
    table = materialise(
        known.select("id", F.size("w").cast("long").alias("n_words"), "lic", F.when(F.arrays_overlap("lic", _array(ANCHORS)), F.col("w")).alias("words")), "license-words"
    )
    counts = {r.word: r.n for r in table.select(F.explode("lic").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most one row a vocabulary word
    rows = table.count()
    idf = {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in vocab}

    postings: dict[str, list[dict[str, int]]] = {}
    library = []
    for t, (label, key, text) in enumerate(TEMPLATES):
        tw, kw = text.split(), key.split()
        at = next(k for k in range(len(tw)) if tw[k : k + len(kw)] == kw)
        seed = min(range(len(kw)), key=lambda k: (-idf[kw[k]], kw[k], k))
        postings.setdefault(kw[seed], []).append({"t": t, "p": at + seed})
        weight = [idf[w] for w in tw]
        library.append({"label": label, "words": tw, "key": list(range(at, at + len(kw))), "weight": [x / sum(weight) for x in weight]})
    index = _const(postings, "map<string,array<struct<t:int,p:int>>>")
    books = _const(library, "array<struct<label:string,words:array<string>,key:array<int>,weight:array<double>>>")

    seeds = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s.w.isin(list(postings)))
    # A template has one posting, so no start comes twice.
    starts = F.flatten(F.transform("seeds", lambda s: F.transform(F.element_at(F.col("index"), s.w), lambda q: F.struct(q.t.alias("t"), (s.i - q.p).alias("a")))))

    def stands(book: Column, a: Column, k: Column) -> Column:
        return F.coalesce(F.get(F.col("words"), a + k) == F.get(book.words, k), F.lit(False))

    def judged(c: Column) -> Column:
        book = F.get(F.col("books"), c.t)
        score = F.aggregate(F.sequence(F.lit(0), F.size(book.words) - 1), F.lit(0.0), lambda acc, k: acc + F.when(stands(book, c.a, k), F.get(book.weight, k)).otherwise(0.0))
        key = F.forall(book.key, lambda k: stands(book, c.a, k))
        return F.struct(book.label.alias("label"), F.when(key, score).otherwise(0.0).alias("score"))

    found = F.filter(F.transform("starts", judged), lambda x: x.score >= LEAST)
    base = [_places(F.col("words"), p) for p in BASE]
    own = [F.when(F.size(x) > 0, F.lit(label)) for x, label in zip(base, BASE.values(), strict=True)]
    some = F.size("words") > 0
    rows = (
        table.withColumn("index", index)
        .withColumn("books", books)
        .withColumn("seeds", seeds)
        .withColumn("starts", starts)
        .withColumn("found", F.when(some, found))
        .withColumn("places", F.when(some, F.flatten(F.array(*base))))
        .withColumn("own", F.when(some, F.array_compact(F.array(*own))))
    )
    none = F.array().cast("array<string>")
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    own, method = F.coalesce("own", none), F.coalesce(F.col("found.label"), none)
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        listed(own).alias("base_labels"),
        listed(F.concat(own, method)).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("found.score")), F.lit(0.0))).alias("score"),
    )
