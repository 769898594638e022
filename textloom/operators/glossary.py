"""Glossary terms: how often each stands in a text, which a chunk needs, and what contradicts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

TOP, MOST = 20, 50
#: Forms up to which a glossary is broadcast; forms that aren't plain words, up to which each text is searched for every one.
BROADCAST_FORMS, PATTERN_FORMS = 200_000, 10_000
#: Ids of several rows up to which they are broadcast; bytes of texts that are read at a time, or one longer text.
BROADCAST_IDS, PIECE = 200_000, 500_000
WORD = r"[\p{L}\p{N}_]+"
TERM = "id string, source string, target string, category string, aliases array<string>"
#: An invented glossary for the queries; words of the test tables.
TERMS = [
    ("t1", "the", "le", "function", ["of"]),
    ("t2", "tion", "sion", "suffix", []),
    ("t3", "with", "avec", "function", ["from"]),
    ("t4", "was", "war", "verb", []),
    ("t5", "der", "the", "article", ["die", "und"]),
    ("t6", "que", "that", "function", []),
    ("t7", "idiot", "fool", "insult", ["clown"]),
    ("t8", "license", "licence", "law", ["MIT License"]),
]
#: And as many numbers, of which most texts hold few.
NUMBERS = 200


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS + [(f"n{k}", str(k), f"no. {k}", "number", []) for k in range(NUMBERS)], TERM)


def surfaces(terms_: DataFrame) -> DataFrame:
    """A row for the source and for each alias of a term."""
    return terms_.select("id", "source", F.explode(F.concat(F.array("source"), F.coalesce("aliases", F.array()))).alias("surface")).where("surface <> ''")


def matches(surface: str) -> str:
    """Pattern of a surface form: whole words, space, hyphen and no-break space alike; CJK anywhere."""
    body = re.sub(r"(?:\\?[ \- ])+", r"[ \\-\\x{00A0}]+", "".join(f"\\x{{{ord(c):X}}}" if not c.isalnum() and c not in " - " else c for c in surface))
    if re.search("[぀-ヿ㐀-鿿가-힣]", surface):
        return body if len(surface) > 1 else r"(?!)"
    return rf"(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_])" if surface.isascii() else body


def frequencies(texts: DataFrame, surfaces_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id and n: a term counts in all its forms.

    Forms of one plain word join the words of the texts, which are read once; the glossary is broadcast up
    to BROADCAST_FORMS forms and shuffled beyond. Other forms (of several words, with signs, not ASCII) are
    a pattern each, looked for where the text holds their first word; over PATTERN_FORMS of those are refused.
    Null and empty texts hold no term; rows that repeat their keys count together.
    """
    forms = surfaces_.select("id", "surface").where("surface IS NOT NULL").distinct()
    plain = F.col("surface").rlike("^[A-Za-z0-9_]+$")
    rows = forms.where(~plain).limit(PATTERN_FORMS + 1).collect()
    if len(rows) > PATTERN_FORMS:
        raise ValueError(f"over {PATTERN_FORMS} forms of a glossary aren't plain words")
    words = forms.where(plain).select("id", F.col("surface").alias("_word"))
    if words.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS:
        words = F.broadcast(words)
    held = texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("_word"))
    found = held.join(words, "_word").groupBy(*keys, "id").agg(F.count("*").alias("n"))
    if rows:
        head = lambda s: re.split(r"[ \-\u00a0]", s)[0]
        count = lambda s: F.when(F.contains("text", F.lit(head(s))), F.regexp_count("text", F.lit(matches(s)))).otherwise(0)
        counts = [F.struct(F.lit(r["id"]).alias("id"), count(r["surface"]).cast("long").alias("n")) for r in sorted(rows)]
        more = texts.select(*keys, F.explode(F.filter(F.array(*counts), lambda x: x["n"] > 0)).alias("x")).select(*keys, "x.*")
        found = found.unionByName(more)
    return found.groupBy(*keys, "id").agg(F.sum("n").alias("n"))


def select_terms(texts: DataFrame, local: DataFrame, terms_: DataFrame, keys: list[str], top: int = TOP, most: int = MOST) -> DataFrame:
    """The terms of each text: its own first, then the `top` most frequent of the others, `most` in all.

    Both by frequency, then source, then id; a text without a term of its own gets the frequent ones. Terms
    that stand nowhere have frequency 0 and are still terms.
    """
    freq = terms_.select("id", "source").join(local.groupBy("id").agg(F.sum("n").alias("_freq")), "id", "left")
    term = F.struct((-F.coalesce("_freq", F.lit(0))).alias("less"), "source", "id").alias("term")
    every = freq.select("id", term)
    leaders = every.orderBy("term").limit(top + most).agg(F.sort_array(F.collect_list("term"))).scalar()
    small = terms_.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS
    own = local.join(F.broadcast(every) if small else every, "id").groupBy(*keys).agg(F.sort_array(F.collect_list("term")).alias("own"))
    rows = texts.select(*keys).join(own, keys, "left").withColumn("own", F.coalesce("own", F.array())).withColumn("all", leaders)
    rest = F.slice(F.filter("all", lambda x: ~F.exists("own", lambda y: y["id"] == x["id"])), 1, top)
    mark = lambda c, v: F.transform(c, lambda x: F.struct(x["id"].alias("id"), F.lit(v).alias("own"), (-x["less"]).alias("freq")))
    chosen = F.slice(F.concat(mark("own", True), mark(rest, False)), 1, most)
    return rows.select(*keys, F.posexplode(chosen).alias("rank", "x")).select(*keys, (F.col("rank") + 1).cast("long").alias("rank"), "x.*")


def left_untranslated(pairs: DataFrame, terms_: DataFrame, keys: list[str]) -> DataFrame:
    """Terms whose source stands in source and output, though the output lacks the target.

    Image links, addresses and code spans of the output don't count. Rows of null texts find nothing.
    """
    body = F.regexp_replace("output", r"!\[[^\]]*\]\([^)]*\)|<img[^>]*>|https?://\S+|`[^`\n]+`", " ")
    forms = terms_.where("target <> '' AND source <> '' AND target <> source")
    stands = frequencies(pairs.select(*keys, body.alias("text")), forms.select("id", F.col("source").alias("surface")), keys)
    near = stands.join(forms.select("id", F.col("source").alias("_from"), F.col("target").alias("_to")), "id").join(pairs.select(*keys, "source", "output"), keys)
    bad = near.where(F.contains("source", "_from") & ~F.contains("output", "_to"))
    return bad.select(*keys, F.lit("glossary").alias("check"), F.lit("fail").alias("severity"), F.col("id").alias("detail"))


def term_hash() -> Column:
    """SHA-256 over source, target, category and, if there are any, the sorted aliases as a JSON list."""
    quoted = F.transform(F.sort_array("aliases"), lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    tail = F.when(F.size("aliases") > 0, F.concat(F.lit('|aliases=["'), F.array_join(quoted, '", "'), F.lit('"]'))).otherwise("")
    return F.sha2(F.concat("source", F.lit("→"), "target", F.lit("|"), "category", tail), 256)


def surface_violations(terms_: DataFrame) -> DataFrame:
    """Surface forms that more than one term claims."""
    return surfaces(terms_).groupBy("surface").agg(F.countDistinct("id").alias("n_terms")).where("n_terms > 1")


def confidence(n: Column) -> Column:
    return F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low")


#: Every byte of UTF-8 as a lower-case ASCII letter, or 0.
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(97, 123)


def _new_words(texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Row, word and place of each word (ASCII letters, in lower case) where it stands first in its row, by pieces of the rows."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        at = offsets[i : j + 1] - offsets[i]
        low = _LETTERS[data[offsets[i] : offsets[j]]]
        letter = low > 0
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        heads = at[:-1][at[:-1] < len(low)]
        begins[heads] = letter[heads]
        solid, bounds = low[letter], np.flatnonzero(begins[letter])
        if n := len(bounds):
            words = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(bounds, len(solid)).astype(np.int32)), pa.py_buffer(solid))
            firsts = np.searchsorted(np.flatnonzero(begins), at)
            row = np.repeat(np.arange(j - i), np.diff(firsts))
            codes = words.dictionary_encode()
            # numbers are given in order of first appearance: the first of its row is the one that gets a new number
            pairs = pa.array(row * len(codes.dictionary) + codes.indices.to_numpy()).dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.diff(np.maximum.accumulate(pairs), prepend=-1))
            yield pa.array(row[new] + i), words.take(pa.array(new)), pa.array(new - firsts[row[new]])
        i = j


def first_uses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, gloss and first_place: where each word (ASCII letters, in lower case) stands first among the words of a text.

    Each row's words are made distinct by themselves, so that nothing is shuffled but the ids, to find those
    of several rows (null is one id): only their words are grouped, with the least place of all rows; over
    BROADCAST_IDS of such ids, those of all rows are. Null and empty texts have no words.
    """
    spec = StructType([docs.schema[key]]).add("gloss", StringType()).add("first_place", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, word, place in _new_words(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), word, place], names=spec.names)

    words = lambda d: d.select(key, text).mapInArrow(run, spec)
    merged = lambda d: words(d).groupBy(key, "gloss").agg(F.min("first_place").alias("first_place"))
    repeated = docs.groupBy(F.col(key).alias("_id")).count().where("count > 1").select("_id")
    n = repeated.limit(BROADCAST_IDS + 1).count()
    if n == 0:
        return words(docs)
    if n > BROADCAST_IDS:
        return merged(docs)
    among = lambda how: docs.join(F.broadcast(repeated), F.col(key).eqNullSafe(F.col("_id")), how)
    return words(among("left_anti")).unionByName(merged(among("left_semi")))
