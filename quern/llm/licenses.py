"""Licence scans by a positional index of rare words, with DataFrame functions only.

Each template is a phrase with a part that must stand word for word. An index has, for
each mandatory word, its rank by inverse document frequency over all documents and its
postings: the templates that ask for it, and where. A file's licence words are looked
up there; each template all of whose mandatory words the file has is entered by the
rarest of them in the file. Every place of that word sets one relative position of
template and file, along which the other words are intersected and the mandatory part
is verified. Index and templates are two constants of the plan, which is the same for
ten templates and for hundreds.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import let


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    #: First word and number of words of the part that must stand word for word.
    key: tuple[int, int]
    #: A base phrase has to stand whole; of others, a part of NEAR is enough beside the key.
    base: bool = False


def _t(label: str, text: str, key: str, base: bool = False) -> Template:
    words, part = tuple(text.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    return Template(label, words, (at, len(part)), base)


#: Part of a template's words that has to be in place.
NEAR = 0.8

# The base phrases, and public licences' own words in lower case.
TEMPLATES = (
    _t("cc-by", "cc by", "cc by", True),
    _t("gpl", "general public license", "general public license", True),
    _t("reserved", "all rights reserved", "all rights reserved", True),
    _t("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    _t("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    _t("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _t("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    _t("mit-name", "licensed under the mit license", "mit license"),
    _t("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KELVIN = "K"


def _words(text: Column) -> Column:
    """Words in order. lower() also lowers letters beyond ASCII, none of which then is an ASCII word, but for the Kelvin sign: that is set aside first."""
    plain = F.when(text.contains(_KELVIN), F.translate(text, _KELVIN, "å")).otherwise(text)
    return F.array_remove(F.split(F.lower(F.coalesce(plain, F.lit(""))), _GAPS), "")


def _constant(value: object, kind: str) -> Column:
    """A value of any size as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of a fixed list of words stands; one row a word comes to the driver."""
    found = docs.select(F.explode(F.array_intersect(_words(F.col("text").cast("string")), _constant(words, "array<string>"))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


_INDEX = "map<string,struct<rank:int,postings:array<struct<t:int,at:int,needs:int>>>>"
_TEMPLATES = "array<struct<label:string,base:boolean,words:array<string>,key:array<string>,key_at:int,least:double>>"


def _index(templates: tuple[Template, ...], frequency: dict[str, int]) -> dict[str, dict]:
    """By mandatory word: its rank, 0 for the rarest, and for each template that asks for it the first place in its words and how many different words are mandatory there."""
    postings: dict[str, list[dict]] = {}
    for t, (_, words, (a, n), _) in enumerate(templates):
        key = words[a : a + n]
        for w in sorted(set(key)):
            postings.setdefault(w, []).append({"t": t, "at": a + key.index(w), "needs": len(set(key))})
    # the least frequent word has the highest inverse document frequency
    order = sorted(postings, key=lambda w: (frequency.get(w, 0), w))
    return {w: {"rank": r, "postings": postings[w]} for r, w in enumerate(order)}


def _entered(words: Column, index: Column, vocabulary: Column) -> Column:
    """Array of (t, rank, at, needs, word): the templates all of whose mandatory words the file has, each with the rarest of these."""
    postings = F.flatten(F.transform(F.array_intersect(words, vocabulary), lambda w: let(F.element_at(index, w), lambda e: F.transform(e["postings"], lambda p: F.struct(p["t"].alias("t"), e["rank"].alias("rank"), p["at"].alias("at"), p["needs"].alias("needs"), w.alias("word"))))))
    # by template, then rank: the first of a template's postings is the rarest, and the last that it needs has to be its own
    first = lambda x, e, i: (i == 0) | (F.get(x, i - 1)["t"] != e["t"])
    whole = lambda x, e, i: F.get(x, i + e["needs"] - 1)["t"] == e["t"]
    return let(F.array_sort(postings), lambda x: F.filter(x, lambda e, i: first(x, e, i) & F.coalesce(whole(x, e, i), F.lit(False))))


def _places(words: Column, entered: Column, templates: Column) -> Column:
    """Array of (label, word, part, base): where the entered templates stand."""
    anchors = F.transform(entered, lambda e: e["word"])
    anchored = let(anchors, lambda a: F.filter(F.transform(words, lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda p: F.array_contains(a, p["word"])))

    def in_place(part: Column, start: Column) -> Column:
        """How many words of a part stand in the file from `start` on, each in its place."""
        return F.size(F.filter(part, lambda w, j: F.coalesce(F.get(words, start + j) == w, F.lit(False))))

    def of(e: Column, t: Column, places: Column) -> Column:
        starts = F.transform(F.filter(places, lambda p: p["word"] == e["word"]), lambda p: p["at"] - e["at"])
        keyed = F.filter(starts, lambda s: in_place(t["key"], s + t["key_at"]) == F.size(t["key"]))
        found = F.transform(keyed, lambda s: F.struct(t["label"].alias("label"), s.cast("long").alias("word"), (in_place(t["words"], s) / F.size(t["words"])).cast("double").alias("part"), t["base"].alias("base")))
        return F.filter(found, lambda p: p["part"] >= t["least"])

    return let(anchored, lambda places: F.flatten(F.transform(entered, lambda e: let(F.get(templates, e["t"]), lambda t: of(e, t, places)))))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for each row of `docs` (doc_id and text are read; other columns are left alone).

    n_base counts all places of base phrases, first_word and last_word are the least and
    greatest start among them (words from 0), null without any. labels has the labels of
    base phrases and of the other templates found, distinct, sorted and comma-joined;
    both are empty texts when there is none. score is the largest part of a found
    template's words that is in place: 1 for a base phrase, 0 for none. places lists
    (label, word, part) of all that is found. Null and empty texts have no words. Null
    doc_ids and repeated rows are each scanned; an empty table gives no rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = sorted({w for t in templates for w in t.words[t.key[0] : sum(t.key)]})
    index = _index(templates, document_frequencies(read, vocabulary))
    whole = _constant([{"label": t.label, "base": t.base, "words": t.words, "key": t.words[t.key[0] : sum(t.key)], "key_at": t.key[0], "least": 1.0 if t.base else NEAR} for t in templates], _TEMPLATES)
    worded = read.select("doc_id", _words(F.col("text")).alias("words"))
    entered = worded.select("doc_id", "words", _entered(F.col("words"), _constant(index, _INDEX), _constant(vocabulary, "array<string>")).alias("entered"))
    none = F.array().cast("array<struct<label:string,word:long,part:double,base:boolean>>")
    found = entered.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("entered") > 0, _places(F.col("words"), F.col("entered"), whole)).otherwise(none).alias("places"))
    of_base = F.filter("places", lambda p: p["base"])
    starts = F.transform(of_base, lambda p: p["word"])
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(of_base).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["part"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda p: F.struct(p["label"].alias("label"), p["word"].alias("word"), p["part"].alias("part"))).alias("places"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The query's columns without `places`, for DuckDB."""
    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, {len(t.words)}, {j}, '{w}', {str(t.key[0] <= j < sum(t.key)).lower()}, {t.key[1]})" for t in templates for j, w in enumerate(t.words))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
t(label, base, m, j, word, key, k) AS (VALUES {rows}),
a AS (SELECT doc_id, label, base, pos - j AS start, count(*) / any_value(m) AS part
      FROM p JOIN t USING (word) GROUP BY doc_id, label, base, pos - j
      HAVING count(*) FILTER (key) = any_value(k) AND count(*) / any_value(m) >= CASE WHEN base THEN 1.0 ELSE {NEAR} END),
s AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score
      FROM a GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (doc_id)"""
