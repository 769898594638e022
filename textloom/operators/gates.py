"""Validation gates of a source against its output. A gate emits rows (keys, check, severity); it filters nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import count_matches, flatten_space, fold_typography, solid_length

#: Fixed values of the length gate and of a chat opener.
LOW, HIGH, FLOOR, BOOK_SHARE, MEDIAN_LEAST, SHORT = 0.35, 2.5, 0.20, 0.55, 3, 200
#: What a chat opener and a closing note look like, a line each.
OPENER = (
    r"^\s*(?:Here(?:'s| is)\b[^\n]*|Sure[,!][^\n]*|Certainly[,!][^\n]*|I(?:'ll| will| have)\b[^\n]*translat[^\n]*|(?:Below|Following) is\b[^\n]*translat[^\n]*"
    r"|Translated (?:text|content|markdown)\s*:?[^\n]*|번역(?:본|문)?\s*[:입니][^\n]*|以下[^\n]*翻译[^\n]*)$"
)
NOTE = r"(?i)^\s*(?:Note\s*:|Notes?\s+on\s+the\s+translation|번역\s*노트\s*:|I hope this helps|Let me know if)[^\n]*$"
#: Lines that count as structure, images, and numerals whose spelling moves between languages.
STRUCTURE = (("headings", r"^#{1,6}\s+\S", "warn"), ("table_rows", r"^\s*\|[^\n]*\|\s*$", "fail"), ("list_items", r"^\s*(?:[-*+]\s+|[0-9]+[.)]\s+)\S", "warn"))
FENCE = r"^\s*(?:```|~~~)"
IMAGES = (("markdown", r"!\[[^\]]*\]\(([^)\s]+)"), ("html", r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""))
LEAK_WINDOW, LEAK_STEP, LEAK_REGION = 60, 30, 180
GROUPED = r"(?<![\p{L}\p{N}_.,])([0-9]+[.,][0-9]+)(?![0-9.,])"
ATTACHED = r"(?<![\p{L}\p{N}_.,])([0-9]+(?:[.,][0-9]+)?(?:%|ms|GB|Hz))(?![\p{L}\p{N}_])"
MAGNITUDE = r"(?i)(?<![\p{L}\p{N}_.,])([0-9]+(?:[.,][0-9]+)?)\s*(?:million|billion|trillion|thousand|hundred)\b"


def _finding(rows: DataFrame, keys: list[str], check: str, severity: Column | str, detail: Column) -> DataFrame:
    s = severity if isinstance(severity, Column) else F.lit(severity)
    return rows.select(*keys, F.lit(check).alias("check"), s.alias("severity"), detail.alias("detail"))


def structure(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Headings, table rows and list items may not become fewer."""
    lost = lambda k, p, s: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), count_matches(F.col("source"), "(?md)" + p).alias("a"), count_matches(F.col("output"), "(?md)" + p).alias("b"))
    rows = pairs.select(*keys, F.explode(F.array(*(lost(*x) for x in STRUCTURE))).alias("x"))
    return _finding(rows.where("x.b < x.a"), keys, "structure", F.col("x.severity"), F.col("x.kind"))


def fences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """An odd number of code fences in the output."""
    rows = pairs.where(count_matches(F.col("output"), "(?md)" + FENCE) % 2 == 1)
    return _finding(rows, keys, "fences", "fail", F.lit("odd"))


def commentary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A chat opener in the first three lines, a note in the last three, or one fence around everything."""
    bare = F.regexp_replace("output", r"^\s+|\s+$", "")
    lines = F.split(bare, "\n")
    kinds = {
        "opener": F.exists(F.slice(lines, 1, 3), lambda x: x.rlike(OPENER)),
        "note": F.exists(F.slice(F.reverse(lines), 1, 3), lambda x: x.rlike(NOTE)),
        "fenced": bare.startswith("```") & bare.endswith("```") & (F.length(bare) - F.length(F.replace(bare, F.lit("```"), F.lit(""))) == 6),
    }
    rows = pairs.select(*keys, F.explode(F.array(*(F.when(c, k) for k, c in kinds.items()))).alias("kind")).where("kind IS NOT NULL")
    return _finding(rows, keys, "commentary", "fail", F.col("kind"))


def numerals(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Numerals with a separator, a percent sign or a unit, but no magnitude word, that the output nowhere holds verbatim."""
    every = lambda p: F.regexp_extract_all("source", F.lit(p), 1)
    wanted = F.array_except(F.array_union(every(GROUPED), every(ATTACHED)), every(MAGNITUDE))
    rows = pairs.select(*keys, F.explode(F.filter(wanted, lambda n: ~F.contains(F.col("output"), n))).alias("n"))
    return _finding(rows, keys, "numerals", "fail", F.col("n"))


def images(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Image references that the output lost (fail) or gained (warn), each with how many times."""
    found = []
    for kind, pattern in IMAGES:
        side = lambda c, sign: pairs.select(*keys, F.explode(F.regexp_extract_all(c, F.lit(pattern), 1)).alias("image"), F.lit(sign).alias("n"))  # noqa: B023,E731
        found.append(side("source", 1).unionByName(side("output", -1)).withColumn("kind", F.lit(kind)))
    rows = found[0].unionByName(found[1]).groupBy(*keys, "kind", "image").agg(F.sum("n").alias("n")).where("n <> 0")
    return rows.select(*keys, F.lit("images").alias("check"), F.when(F.col("n") > 0, "fail").otherwise("warn").alias("severity"), "kind", F.col("image").alias("detail"), F.abs("n").alias("n"))


def reference_verbatim(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Reference chunks whose entries, below an opening heading, changed; the detail is by how many characters."""
    entries = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s*#{1,6}[^\n]*\n", ""), r"^\s+|\s+$", "")
    rows = pairs.select(*keys, entries("source").alias("a"), entries("output").alias("b")).where("a <> b")
    return _finding(rows, keys, "reference_verbatim", "fail", F.abs(F.length("a") - F.length("b")).cast("string"))


def evidence(quotes: DataFrame, chunks: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Quotes of at least `least` characters that their chunk doesn't hold; white space and typography don't matter.

    quotes: keys, field, quote; chunks: keys, source. A null quote offers nothing.
    """
    fold = lambda c: fold_typography(flatten_space(F.col(c)))
    rows = quotes.select(*keys, "field", "quote", fold("quote").alias("_quote")).where(F.length("_quote") >= least)
    bad = rows.join(chunks.select(*keys, fold("source").alias("_source")), keys).where(~F.contains("_source", "_quote"))
    return _finding(bad, [*keys, "field"], "meta_evidence", "fail", F.left("quote", F.lit(100)))


def untranslated(pairs: DataFrame, keys: list[str]) -> DataFrame:
    rows = pairs.where((flatten_space(F.col("source")) == flatten_space(F.col("output"))) & F.col("source").rlike(r"\p{L}"))
    return _finding(rows, keys, "untranslated", "fail", F.lit("identical"))


def upper_median(x: Column) -> Column:
    """The element at size/2 of the sorted values; null for fewer than MEDIAN_LEAST."""
    sorted_ = F.sort_array(F.collect_list(x))
    return F.when(F.size(sorted_) >= MEDIAN_LEAST, F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int")))


def lengths(pairs: DataFrame, keys: list[str], book: str) -> DataFrame:
    """Output to source length, without white space, below the floor or above HIGH; short sources are skipped.

    The floor is LOW, or with a median of the book max(FLOOR, BOOK_SHARE x median).
    """
    sized = pairs.select(*keys, solid_length(F.col("source")).alias("a"), solid_length(F.col("output")).alias("b")).where(F.col("a") >= SHORT).withColumn("ratio", F.col("b") / F.col("a"))
    medians = sized.groupBy(book).agg(upper_median(F.col("ratio")).alias("median"))
    floor = F.when(F.col("median").isNull(), LOW).otherwise(F.greatest(F.lit(FLOOR), F.col("median") * BOOK_SHARE))
    judged = sized.join(medians, book).withColumn("severity", F.when(F.col("ratio") < floor, "fail").when(F.col("ratio") > HIGH, "warn"))
    return _finding(judged.where("severity IS NOT NULL"), keys, "length", F.col("severity"), F.when(F.col("severity") == "fail", "short").otherwise("long"))


def script_ratio(rows: DataFrame, keys: list[str], text: str, script: str) -> DataFrame:
    """Letters of the script over those and Latin ones."""
    target = F.length(F.regexp_replace(F.col(text), f"[^{script}]", "")).cast("long")
    latin = F.length(F.regexp_replace(F.col(text), "[^A-Za-z]", "")).cast("long")
    return rows.select(*keys, target.alias("target"), latin.alias("latin")).withColumn("ratio", F.try_divide(F.col("target"), F.col("target") + F.col("latin")))


def untranslated_lines(lines: DataFrame, words: int = 14, most: int = 5) -> DataFrame:
    """Lines without the target script and with many Latin words, at most `most` of a document."""
    n = count_matches(F.col("line"), "[A-Za-z]+")
    rows = lines.where((n >= words) & ~F.col("line").rlike(r"[\x{AC00}-\x{D7A3}]")).withColumn("n_words", n)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("doc_id", "line_no", "n_words")


def token_diff(pairs: DataFrame, keys: list[str], pattern: str, check: str) -> DataFrame:
    """Multiset difference of tokens: lost, repeated or foreign ones, with both counts."""
    side = lambda c, n: pairs.select(*keys, F.explode(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(n))
    both = side("source", "n_source").join(side("output", "n_output"), [*keys, "token"], "full_outer").fillna(0, ["n_source", "n_output"]).where("n_source <> n_output")
    kind = F.when(F.col("n_output") == 0, "missing").when(F.col("n_source") == 0, "foreign").when(F.col("n_output") > F.col("n_source"), "repeated").otherwise("fewer")
    return both.select(*keys, F.lit(check).alias("check"), "token", kind.alias("kind"), "n_source", "n_output")


def neighbour_context(rows: DataFrame, book: str, order: str, text: str, n: int = 300) -> DataFrame:
    """The end of the text before and the beginning of the one after."""
    w = Window.partitionBy(book).orderBy(order)
    return rows.select(book, order, F.right(F.lag(text).over(w), F.lit(n)).alias("before"), F.left(F.lead(text).over(w), F.lit(n)).alias("after"))


def neighbour_leak(rows: DataFrame, book: str, order: str, source: str, output: str) -> DataFrame:
    """Rows whose output holds a stretch of the source before, which their own source doesn't hold."""
    w = Window.partitionBy(book).orderBy(order)
    near = rows.withColumn("_near", F.right(F.lag(source).over(w), F.lit(LEAK_REGION))).where(F.length("_near") >= LEAK_WINDOW)
    cuts = F.transform(F.sequence(F.lit(1), F.length("_near") - (LEAK_WINDOW - 1), F.lit(LEAK_STEP)), lambda k: F.substring("_near", k, F.lit(LEAK_WINDOW)))
    hit = F.exists(cuts, lambda c: F.contains(F.col(output), c) & ~F.contains(F.col(source), c))
    return _finding(near.where(hit), [book, order], "neighbor_leak", "fail", F.lit("before"))


def neighbour_leaks(rows: DataFrame, book: str, order: str, source: str, output: str) -> DataFrame:
    """Rows whose output holds a stretch of the source before or after, which their own source doesn't hold; line breaks don't matter."""
    w = Window.partitionBy(book).orderBy(order)
    flat = rows.select(book, order, flatten_space(F.col(source)).alias("_own"), flatten_space(F.col(output)).alias("_out"))
    near = flat.withColumn("before", F.right(F.lag("_own").over(w), F.lit(LEAK_REGION))).withColumn("after", F.left(F.lead("_own").over(w), F.lit(LEAK_REGION)))
    sides = near.select(book, order, "_own", "_out", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("near")) for c in ("before", "after")))).alias("x"))
    long_ = sides.select(book, order, "_own", "_out", "x.*").where(F.length("near") >= LEAK_WINDOW)
    cuts = F.transform(F.sequence(F.lit(1), F.length("near") - (LEAK_WINDOW - 1), F.lit(LEAK_STEP)), lambda k: F.substring("near", k, F.lit(LEAK_WINDOW)))
    hit = F.exists(cuts, lambda c: F.contains("_out", c) & ~F.contains("_own", c))
    return _finding(long_.where(hit), [book, order], "neighbor_leak", "fail", F.col("side"))
