"""Manifests, the plan of what has to be done again, and entity observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glossary import confidence

#: Rules of the plan in order; the first that holds decides.
RULES = [
    ("output IS NULL", "missing", "translate"),
    ("output = ''", "empty", "translate"),
    ("trim(output) = ''", "blank", "translate"),
    ("recorded_source IS NULL", "untracked", "record"),
    ("recorded_source <> source_hash", "source_changed", "translate"),
    ("recorded_terms <> term_hash", "terms_changed", "translate"),
    ("recorded_output <> output_hash", "output_changed", "record"),
]


def manifest(chunks: DataFrame, book: str, order: str, text: str) -> DataFrame:
    """A row for each chunk with its hash."""
    return chunks.select(book, order, F.sha2(F.coalesce(text, F.lit("")), 256).alias("source_hash"))


def plan(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason, action by the first rule that holds, else unchanged and none."""
    case = lambda at: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[at]}'" for r in RULES) + f" ELSE '{('unchanged', 'none')[at - 1]}' END"
    return state.select(*keys, F.expr(case(1)).alias("reason"), F.expr(case(2)).alias("action"))


def validate_merge(joined: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem, severity of a chunk that can't be merged, or whose output is under a tenth of its source."""
    problem = F.expr("CASE WHEN source IS NULL THEN 'missing_source' WHEN output IS NULL THEN 'missing_output' WHEN output = '' THEN 'empty' WHEN trim(output) = '' THEN 'blank' WHEN octet_length(output) * 10 < octet_length(source) THEN 'small' END")
    return joined.select(*keys, problem.alias("problem")).where("problem IS NOT NULL").withColumn("severity", F.when(F.col("problem") == "small", "warn").otherwise("error"))


def proposals(observed: DataFrame) -> DataFrame:
    """source, n_pairs, n_evidence, decision, confidence: one (target, category) applies itself, several conflict."""
    rows = observed.groupBy("source").agg(F.countDistinct("target", "category").alias("n_pairs"), F.countDistinct("chunk").alias("n_evidence"), F.min("target").alias("first_target"))
    return rows.withColumn("decision", F.when(F.col("n_pairs") == 1, "auto").otherwise("conflict")).withColumn("confidence", confidence(F.col("n_evidence")))
