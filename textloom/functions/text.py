"""Column expressions of line and text cleaning; all run inside code generation or Java's regex."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that typography varies, and what they are compared as.
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "ﬁ": "fi", "ﬂ": "fl"}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
SPACE = r"[\s ]+"


def normalize_newlines(t: Column) -> Column:
    return F.regexp_replace(t, r"\r\n?", "\n")


def flatten_space(t: Column) -> Column:
    """Any run of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(t, SPACE, " "))


def rejoin_hyphens(t: Column) -> Column:
    """A word broken at a line's end becomes whole; a line that a sentence runs on from joins the next."""
    whole = F.regexp_replace(t, r"([\p{L}])-\n([\p{Ll}])", "$1$2")
    return F.regexp_replace(whole, r"([^.!?:;\n])\n([\p{Ll}(])", "$1 $2")


def escape_hashes(t: Column) -> Column:
    return F.regexp_replace(t, r"(?m)^(#+ )", r"\\$1")


def collapse_blank_runs(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def fold_typography(t: Column) -> Column:
    folded = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), TYPOGRAPHY.items(), t)
    return F.regexp_replace(folded, "-{2,}", "-")


def visible_text(html: Column) -> Column:
    """What a page shows: no scripts, styles and tags, common entities decoded, white space flattened."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|annotation)[^>]*>.*?</(script|style|annotation)>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return flatten_space(reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), bare))


def heading_slug(t: Column) -> Column:
    """Lower case, only word characters, spaces and hyphens, runs of the latter to one hyphen; never empty."""
    s = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s-]", "")
    s = F.regexp_replace(s, r"[\s-]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", "heading").otherwise(s)


def solid_length(t: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(t, SPACE, "")).cast("long")


def count_matches(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern)).cast("long")


def natural_key(t: Column) -> Column:
    """Sorts digits by value: the number of digits stands before each run, without leading zeros, of any length."""
    solid = lambda p: F.regexp_replace(p, "^0+", "")
    sized = lambda p: F.concat(F.lpad(F.length(solid(p)).cast("string"), 10, "0"), solid(p))
    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda p: F.when(p.rlike("^[0-9]+$"), sized(p)).otherwise(F.lower(p))), "")


def strip_comments(t: Column) -> Column:
    r"""LaTeX without `comment` environments and without what follows a `%` that no backslash escapes, line by line."""
    bare = F.regexp_replace(t, r"(?s)\\begin\{comment\}.*?\\end\{comment\}", "")
    return F.regexp_replace(bare, r"(?md)^((?:[^\\%\n]++|\\[^\n])*+)%[^\n]*", "$1")


def canonical_json(row: list[str]) -> Column:
    """The columns as JSON: keys sorted, nulls kept, no white space, characters as they are."""
    return F.to_json(F.struct(*sorted(row)), {"ignoreNullFields": "false"})


def roman(n: Column) -> Column:
    """1 to 3999 in Roman numerals."""
    digits = [("M", "", ""), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")]

    def place(k: int) -> Column:
        one, five, ten = digits[3 - k]
        d = F.floor(n / 10**k) % 10
        shapes = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.get(F.array(*map(F.lit, shapes)), d.cast("int"))

    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(2), place(1), place(0))
