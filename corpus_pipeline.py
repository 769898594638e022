"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, mixing, token ids.

Each stage takes the documents that the one before it kept and returns a table with the columns of
documents; the last one returns a row for each document of the files that it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, jaccard, mixing, token_store, toxicity
from textloom.llm.common import cut, table

#: Words of a shingle.
WORDS = 5


def _carried(docs: DataFrame) -> DataFrame:
    """The whole row in one struct, so that no column of documents clashes with one of an operator."""
    return docs.select(F.struct("*").alias("row"), "doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject; it learns from the labels of documents.

    Null and empty texts stay; rows that repeat are all kept or all dropped; an empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_carried(docs), model, ("row",)).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word-shingle similarity 0.8 one row: of the set that the smallest id names, the row of the smallest doc_id.

    Rows are linked by their texts alone: an id that rows of different sets share, as null mostly is, links
    nothing. Of rows of one id and set the smallest text stays, then the smallest row as JSON. Null texts,
    empty ones and those without words are in no group and all stay.
    """
    return jaccard.one_of_each(docs, WORDS, jaccard.Threshold(80, 100))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts hold none and stay; rows that repeat are all kept or all dropped.
    """
    found = decontaminate.contamination(_carried(docs), table(spark, sf_dir, "benchmark"), keep=("row", "doc_id"))
    return found.where(F.size("hits") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 times.

    A null or empty text has no words and is taken as often as whole copies of its source are; a null
    source is a source of its own; rows of one id and text are taken alike.
    """
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the files; a null or empty text has the end id only."""
    return token_store.stored(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix_sources", mix_sources),
    ("token_output", write_tokens),
]
#: Models and a tokenizer aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", docs)
    return STAGES[-1][1](spark, docs, sf_dir)
