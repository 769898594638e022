"""License scans through a positional rare-token index; DataFrame functions only.

Every template is a run of words with the places of its mandatory key phrase. The index keeps, for
each template, the rarest words of that phrase (highest IDF over all documents) with their places in the template.
A document looks those words up, turns each hit into the place where the template would have to
start, and intersects the starts of the key phrase's rare words; what is left is verified against the
mandatory key phrase. A text that holds the phrase whole holds these words at their places, so none is missed. All of it is one projection of the document, so nothing is shuffled; only the
document counts of the vocabulary, as many as the templates have words, reach the driver.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Of texts in any case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rare words of a template's key phrase that the index looks up; all have to agree on a start.
RARE = 4


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # the mandatory phrase: words[key[0]:key[1]]
    base: bool = False


def _template(label: str, text: str, key: str = "") -> Template:
    words, phrase = tuple(text.split()), tuple(key.split())
    at = next((i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), 0)
    return Template(label, words, (at, at + len(phrase)) if key else (0, len(words)), not key)


#: Phrases that a notice must hold, with their labels.
PHRASES = (
    _template("gpl", "gnu general public license"),
    _template("apache", "apache license"),
    _template("cc-by", "cc by"),
    _template("mit", "mit license"),
)
#: Openings of public notices and the phrase in each that may not be missing.
NOTICES = (
    _template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    _template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    _template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    _template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    _template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)


def words_of(text: Column) -> Column:
    """The words of a text, in its own case; a null text has none.

    Words are lowered where they are compared. lower() turns one character besides A-Z into an ASCII
    letter, the Kelvin sign, so another letter takes its place.
    """
    return F.array_remove(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")), SEPARATORS), "")


def _held(value: Column, name: str) -> Column:
    """Computes a column once: a projection would be merged into every use of it."""
    return F.explode(F.array(value)).alias(name)


def document_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the (fixed) vocabulary stands, written abc, Abc or ABC.

    These counts only say which words are rare; hits are looked up in any case.
    """
    forms = F.array(*(F.lit(f) for w in vocabulary for f in sorted({w, w.capitalize(), w.upper()})))
    found = docs.select(F.explode(F.array_distinct(F.transform(F.array_intersect(words_of(F.col("text")), forms), F.lower))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_words(template: Template, counts: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest words of the template's key phrase and their places in the template, rarest first; ties by place."""
    start, end = template.key
    places = {w: template.words.index(w, start) for w in template.words[start:end]}
    return sorted(places.items(), key=lambda x: (counts.get(x[0], 0), x[1]))[:RARE]


def _array(words: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _starts(template: Template, counts: dict[str, int]) -> str:
    """SQL: starts (from 0) where the rare words of the template's key phrase agree and the phrase stands.

    A start before the text is lawful as long as the key phrase lies inside.
    """
    lists = [f"transform(filter(hits, h -> h.w = '{w}'), h -> h.i - {p})" for w, p in rare_words(template, counts)]
    met = reduce("array_intersect({}, {})".format, lists)
    start, end = template.key
    verified = f"filter(array_distinct({met}), s -> s + {start} >= 0 AND transform(slice(w, greatest(s + {start}, 0) + 1, {end - start}), x -> lower(x)) = {_array(template.words[start:end])})"
    return f"CASE WHEN size(hits) > 0 THEN {verified} ELSE cast(array() AS array<int>) END"


def _notices(template: Template, counts: dict[str, int]) -> str:
    """SQL: the template's label, start and share of words that stand at their places, for each start."""
    n = len(template.words)
    share = f"size(filter(sequence(0, {n - 1}), k -> lower(get(w, s + k)) = get({_array(template.words)}, k))) / {n}D"
    return f"transform({_starts(template, counts)}, s -> named_struct('label', '{template.label}', 'start', s, 'share', {share}))"


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """Adds to `doc_id`: n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    `phrases` are the base: every place where all their words stand consecutively counts. `notices`
    add labels where their key phrase stands, and give `notices`, an array of
    (label, start, share). The score is 1 if a base phrase stands in the text, else the best share of
    a notice, else 0. A null or empty text has no words: counts of 0, null places, empty labels.
    Repeated rows give repeated results; other columns of the input are ignored.
    """
    templates = [*phrases, *notices]
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = document_counts(docs, vocabulary)
    anchors = ", ".join(f"'{a}'" for a in sorted({w for t in templates for w, _ in rare_words(t, counts)}))
    words = docs.select("doc_id", _held(words_of(F.col("text")), "w"))
    hits = F.expr(f"filter(transform(w, (x, i) -> CASE WHEN lower(x) IN ({anchors}) THEN named_struct('w', lower(x), 'i', i) END), h -> h IS NOT NULL)")
    found = words.select("doc_id", "w", _held(hits, "hits"))
    base = F.expr("array(" + ", ".join(f"named_struct('label', '{t.label}', 'at', {_starts(t, counts)})" for t in phrases) + ")")
    more = F.expr("array(" + ", ".join(_notices(t, counts) for t in notices) + ")")
    seen = found.select("doc_id", F.size("w").cast("long").alias("n_words"), _held(F.struct(base.alias("base"), F.flatten(more).alias("notices")), "x")).select("doc_id", "n_words", "x.*")
    places = F.flatten(F.transform("base", lambda b: b["at"]))
    labels = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return seen.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.transform("notices", lambda x: x["label"]))).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0))).alias("score"),
        "notices",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("notices")
