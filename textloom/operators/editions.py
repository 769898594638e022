"""Comparing two editions of one collection: what only one has, what both have, and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apart(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side (a, b) of the keys that one edition has and the other hasn't.

    Repeated keys count once; a null key is a key like any other; an empty edition gives all of the other.
    """
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    held = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return held.where("_a <> _b").select(*keys, F.when(F.col("_a") == 1, "a").otherwise("b").alias("side"))


def shared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that both editions have, each once; a null key is a key like any other."""
    return a.select(*keys).intersect(b.select(*keys))


def line_changes(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, line, ordinal and side of every line that only one of the texts a and b of a row holds.

    The k-th copy of a line meets the k-th copy on the other side, so moved lines don't count as changed.
    A null text has no lines, an empty one has one empty line. Lines are counted before they meet, so a
    line that repeats without end in one text is one row; rows that share their keys are one text.
    """
    sides = [rows.select(*keys, F.lit(s).alias("side"), F.explode(F.split(t, "\n")).alias("line")) for s, t in (("a", a), ("b", b))]
    n = sides[0].unionByName(sides[1]).groupBy(*keys, "line").agg(F.count_if(F.col("side") == "a").alias("_a"), F.count_if(F.col("side") == "b").alias("_b"))
    more = n.where("_a <> _b").withColumn("ordinal", F.explode(F.sequence(F.least("_a", "_b") + 1, F.greatest("_a", "_b"))))
    return more.select(*keys, "line", F.col("ordinal").cast("long").alias("ordinal"), F.when(F.col("_a") > F.col("_b"), "a").otherwise("b").alias("side"))
