"""Censuses, run histories and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import count_matches

BRIEF_SHARE, CHRONIC_RUNS = 0.30, 3
WEIGHTS = {"id": 20, "title": 5, "token": 3, "body": 1}


def census(docs: DataFrame, key: str, text: str, markers: dict[str, str]) -> DataFrame:
    """key, marker, n of every marker that a document holds; one pass over the text."""
    counts = F.array(*(F.struct(F.lit(m).alias("marker"), count_matches(F.col(text), p).alias("n")) for m, p in sorted(markers.items())))
    return docs.select(key, F.explode(F.filter(counts, lambda x: x["n"] > 0)).alias("x")).select(key, "x.marker", "x.n")


def digest(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("marker").agg(F.countDistinct(key).alias("n_docs"), F.sum("n").alias("total"))


def never_seen(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return vocabulary.join(rows.select("marker").distinct(), "marker", "left_anti")


def merge_census(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A marker that was seen stays; a new count takes the place of an old one."""
    return old.withColumnRenamed("n", "o").join(new, [key, "marker"], "full_outer").select(key, "marker", F.coalesce("n", "o").alias("n"))


def judge(rows: DataFrame, history: DataFrame) -> DataFrame:
    """check, n, of, verdict: brief if it hits enough of the chunks, chronic if enough runs have it.

    rows: edition, check, n (chunks hit), of (chunks); history: edition, check of earlier runs.
    """
    runs = history.unionByName(rows.select("edition", "check")).distinct().groupBy("check").agg(F.count("*").alias("runs"))
    verdict = F.when((F.col("n") / F.col("of") >= BRIEF_SHARE) & (F.col("n") > 1), "brief").when(F.col("runs") >= CHRONIC_RUNS, "chronic")
    return rows.join(runs, "check").select("edition", "check", "n", "of", "runs", verdict.alias("verdict")).where("verdict IS NOT NULL")


def upsert(history: DataFrame, run: DataFrame, keys: list[str]) -> DataFrame:
    """The run takes the place of its own rows."""
    return history.join(run.select(*keys).distinct(), keys, "left_anti").unionByName(run)


def worst_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check").agg(F.countDistinct("chunk").alias("n_chunks"), F.when(F.bool_or(F.col("severity") == "fail"), "fail").otherwise("warn").alias("severity"))


def ranked_search(entries: DataFrame, words: list[str], limit: int = 5) -> DataFrame:
    """id, score: a word counts most in the id, then in the title, as a token, and anywhere in the body."""
    score = sum(
        (
            F.when(F.col("id") == w, WEIGHTS["id"]).otherwise(0)
            + F.when(F.contains(F.lower("title"), F.lit(w)), WEIGHTS["title"]).otherwise(0)
            + F.when(F.array_contains("tokens", w), WEIGHTS["token"]).otherwise(0)
            + F.when(F.contains(F.lower("body"), F.lit(w)), WEIGHTS["body"]).otherwise(0)
        )
        for w in words
    )
    return entries.select("id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def furniture(lines: DataFrame, book: str, page: str, share: float = 0.25, least: int = 3) -> DataFrame:
    """Lines that repeat on many pages of a book, digits folded: book, key, n_pages."""
    pages = lines.groupBy(book).agg(F.countDistinct(page).alias("pages"))
    keyed = lines.select(book, page, F.regexp_replace(F.trim("line"), r"\d+", "#").alias("key")).where("key <> ''").distinct()
    found = keyed.groupBy(book, "key").agg(F.count("*").alias("n_pages"))
    return found.join(pages, book).where(F.col("n_pages") >= F.greatest(F.lit(float(least)), F.col("pages") * share)).select(book, "key", "n_pages")


def ordered_merge(chunks: DataFrame, book: str, order: str, text: str) -> DataFrame:
    """The chunks of a book in order, joined by a blank line."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return chunks.groupBy(book).agg(F.array_join(parts, "\n\n").alias("merged")).select(book, F.sha2("merged", 256).alias("merged_sha256"), F.length("merged").cast("long").alias("n_chars"))


def even_sample(rows: DataFrame, book: str, order: str, n: int = 5) -> DataFrame:
    """First, last and evenly spaced rows of a book; all if it has fewer than n."""
    w = Window.partitionBy(book)
    numbered = rows.withColumn("k", F.row_number().over(w.orderBy(order)) - 1).withColumn("of", F.count("*").over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("of") - 1) / (n - 1)))
    return numbered.where((F.col("of") < n) | F.array_contains(spots, F.col("k").cast("long"))).drop("k", "of")
