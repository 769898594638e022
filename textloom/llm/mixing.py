"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the whole collection by weight, none above CAP times its own words. Every
document of a source is taken as often as the target holds the source's words whole: these copies are
certain. The words left are a sample of fixed size in words, with inclusion in proportion to size (and
certain for documents so long that this exceeds 1): documents are ranked by random odds over inclusion
odds, and the smallest are taken until the next would exceed the words left. What is still left then,
less than that document, goes to documents beyond the cut that fit, longest first, by rank within a size.

The rank is cut without sorting a source in one task: ranks are mapped to integers, and the cut is found
by radix, one digit after the other. Each round sums words by (source, digit), which combines before the
shuffle, so a source that holds a third of all rows costs a few thousand partial sums a task; a document
needs only its source's plan. Data grow with documents; what is joined back grows with sources. Tables
by (source, size) have as many rows of a source as it has different sizes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table

#: Weights of the sources in the order of their names, repeating, and the most copies.
WEIGHTS, CAP = (5, 2, 1), 3
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: Digits of the rank, and bits of each.
DIGITS, DIGIT_BITS = 4, 12
BITS = DIGITS * DIGIT_BITS
SEED = 20_240_917


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), "")).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sharing by weight, with what exceeds a cap shared again, ends where every source has the smaller of
    its cap and level x weight; the level is found along the sources by the level at which each is full.
    """
    every = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_total", every).withColumn("_w", F.get(F.array(*map(F.lit, weights)), (place - 1) % len(weights)).cast("double"))
    rows = rows.withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_full", F.col("_cap") / F.col("_w"))
    before = Window.partitionBy(F.lit(0)).orderBy("_full", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(F.lit(0)).orderBy("_full", "source").rowsBetween(0, Window.unboundedFollowing)
    # with the sources before it full and the others not, the level would be:
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    rows = rows.withColumn("_level", level)
    # the first source that isn't full at its own level settles it for all
    settled = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "source", "_level"))).over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("_settled", settled["_level"]).select("source", "source_size", F.coalesce(F.least("_cap", F.col("_settled") * F.col("_w")), F.col("_cap")).alias("target"))


def inclusion(counts: DataFrame) -> DataFrame:
    """source and `_per_word`: inclusion is the smaller of 1 and `_per_word` x size.

    counts: source, size, n, _left (the words that the sample is to take). The longest documents are
    certain, down to the first size at which the rest can share what they leave in proportion to size.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    longer = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    square = F.col("size").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)") * F.col("n")
    rest = F.sum(square.cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    per = (F.col("_left") - longer) / rest
    return counts.withColumn("_per", per).where("_per * size <= 1").groupBy("source").agg(F.max_by("_per", "size").alias("_per_word"))


def _rank(p: Column, key: Column) -> Column:
    """Random odds over inclusion odds, mapped to an integer of BITS bits in the same order."""
    u = (F.pmod(key, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (u * (1 - p)) / ((1 - u) * p)
    return F.least(F.floor((odds / (1 + odds)) * float(1 << BITS)).cast("long"), F.lit((1 << BITS) - 1))


def ranked(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds `_rank`, null for what the sample doesn't take part in, to rows with `_left` and `_per_word`."""
    p = F.least(F.lit(1.0), F.col("_per_word") * F.col("size"))
    return rows.withColumn("_rank", F.when((F.col("_left") > 0) & (F.col("size") > 0), _rank(p, F.xxhash64(F.lit(seed), "doc_id", "_digest"))))


def _with(rows: DataFrame, of_source: DataFrame) -> DataFrame:
    return rows.join(of_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def cuts(rows: DataFrame) -> DataFrame:
    """source, `_cut`: documents of a smaller rank are taken; `_rest`: the words still left then."""
    state = rows.groupBy("source").agg(F.max("_left").alias("_rest")).withColumn("_cut", F.lit(0).cast("long"))
    for d in range(DIGITS):
        shift = BITS - DIGIT_BITS * (d + 1)
        near = _with(rows, state).where(F.shiftright("_rank", shift + DIGIT_BITS) == F.col("_cut"))
        sums = near.groupBy("source", F.shiftright("_rank", shift).alias("_digit")).agg(F.sum("size").alias("_n"), F.max("_rest").alias("_rest"))
        sums = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy("source").orderBy("_digit")))
        # the first digit at which the words left are reached, else the last one
        short = F.col("_upto") < F.col("_rest")
        hit = F.struct(short.alias("short"), F.when(short, -F.col("_digit")).otherwise(F.col("_digit")).alias("order"), "_digit", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("left"))
        # a row for each source
        state = cut(sums.groupBy("source").agg(F.min(hit).alias("h")).select("source", F.col("h.left").alias("_rest"), F.col("h._digit").alias("_cut")), "mixing-cuts")
    return state


def _fit(one: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size fill one source's rest: longest first; at last one more if that comes nearer."""
    rest, out = float(one["_rest"].iloc[0]), []
    for size, n in sorted(zip(one["size"].tolist(), one["n"].tolist(), strict=True), reverse=True):
        k = min(n, int(rest // size))
        rest -= k * size
        out.append([size, n, k])
    left_out = min((x for x in out if x[1] > x[2]), default=None)
    if left_out and left_out[0] < 2 * rest:
        left_out[2] += 1
    out = [x for x in out if x[2]]
    return pd.DataFrame({"source": [one["source"].iloc[0]] * len(out), "size": [x[0] for x in out], "k": [x[2] for x in out]})


def fills(rows: DataFrame, state: DataFrame) -> DataFrame:
    """source, `_fill`: for some sizes, the rank up to which documents beyond the cut are taken as well."""
    beyond = _with(rows, state).where((F.col("_rank") >= F.col("_cut")) & (F.col("size") < 2 * F.col("_rest")))
    sizes = beyond.groupBy("source", "size").agg(F.count("*").alias("n"), F.max("_rest").alias("_rest"))
    fit = cut(sizes.groupBy("source").applyInPandas(_fit, "source string, size long, k long"), "mixing-fits")
    most = fit.agg(F.max("k")).first()[0] or 0  # fewer than the words of a document
    by = Window.partitionBy("source", "size").orderBy("_rank")
    first = beyond.join(fit.withColumnsRenamed({"source": "_s", "size": "_z"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    first = first.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= most)
    upto = F.max("_place").over(Window.partitionBy("source", "size", "_rank"))  # rows of one rank are taken together or not at all
    ends = first.withColumn("_upto", upto).where("_upto <= k").groupBy("source", "size").agg(F.max("_rank").alias("rank"))
    return ends.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("size", "rank"))).alias("_fill"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """A row for each source: source, source_size, target, and what copies needs of it besides a document."""
    sized = cut(_sized(docs), "mixing-sizes")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    shares = targets(sized, weights, cap).withColumn("_whole", copies).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
    shares = cut(shares, "mixing-targets")
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    shares = cut(_with(shares, inclusion(_with(counts, shares.select("source", "_left")).where("_left > 0"))), "mixing-shares", shares)
    rows = ranked(_with(sized, shares.select("source", "_left", "_per_word")), seed).where("_rank IS NOT NULL").select("source", "size", "_rank", "_left")
    state = cuts(rows)
    out = cut(_with(_with(shares, state.drop("_rest")), fills(rows, state)), "mixing-plan", shares)
    discard(sized)
    return out


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_digest"))


def _copies(rows: DataFrame, of_source: DataFrame, cap: float, seed: int) -> DataFrame:
    """Adds source_size, target and copies."""
    rows = ranked(_with(rows, of_source), seed)
    more = F.when((F.col("_rank") < F.col("_cut")) | (F.col("_rank") <= F.try_element_at("_fill", F.col("size"))), 1).otherwise(0)
    return rows.withColumn("copies", F.least(F.col("_whole") + more, F.lit(int(cap)).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0 to `cap`) for every row.

    Sizes are words; a null or empty text has none and is never taken beyond the whole copies. A null
    source is a source of its own, after the others. Rows of one id and text share their rank, so they
    are taken together; reruns agree, whatever the partitions. A source's taken words differ from its
    target by at most half the smallest document that could still be taken, as long as no rows share a
    rank. An empty table gives an empty result; other columns are ignored.
    """
    return _copies(_sized(docs), plan(docs, weights, cap, seed), cap, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs, columns of any name as they were, each as often as mix() takes it; nothing but the sources' plan is joined to them."""
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_digest"))
    rows = _copies(own, plan(docs, weights, cap, seed), cap, seed).where("copies > 0")
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
