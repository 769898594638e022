"""Invented chunk pairs that trigger every gate, and some that trigger none; queries add them to the tables' own pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (source, output); the ids count down from -1.
PAIRS = [
    ("# One\n\n- a\n- b\n\n| x | y |\n| 1 | 2 |\n", "One\n\n- a\n\n| x | y |\n"),
    ("text\n```\ncode\n```\n", "Text\n```\ncode\n"),
    ("Nothing of this was translated.", "Nothing of  this\nwas translated."),
    ("A plain sentence.", "Sure, here is the translation:\n\nEin Satz."),
    ("A plain sentence.", "Ein Satz.\n\nI hope this helps you"),
    ("A plain sentence.", "```\nEin Satz.\n```"),
    ("It rose 58.9% in 10ms, to 60.000 of 1.4 billion; version 1.2.3, 85Hz, 7%x and 5%6.7 or a1.5", "Es stieg um 58,9 % in 10 ms auf 60000 von 1,4 Mrd."),
    ("It is 12.5 GB and 3,000 words", "Es sind 12.5 GB und 3,000 Worte"),
    ("![a](fig/a.png) ![b](fig/b.png) <img src='c.png'>", "![a](fig/a.png) ![a](fig/a.png) <IMG alt=x SRC=\"d.png\">"),
    ("The license of 7 clowns, by an idiot", "Die license von no. 7 clowns, ein fool, `idiot`"),
    ("The license holds", "Die licence, the license"),
    ("## References\n[1] A. Author. 1999.\n", "## Literatur\n[1] A. Author. 1999."),
    ("## References\n[1] A. Author. 1999.\n", "## References\n[1] A. Autor. 1999, S. 5"),
    ("", ""),
]


def pairs(spark: SparkSession) -> DataFrame:
    """doc_id, book, source, output."""
    return spark.createDataFrame([(-k, "made", a, b) for k, (a, b) in enumerate(PAIRS, 1)], "doc_id long, book string, source string, output string")


def _text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


PAIRS_SQL = "(SELECT CAST(doc_id AS BIGINT) AS doc_id, book, source, output FROM (VALUES " + ", ".join(f"({-k}, 'made', {_text(a)}, {_text(b)})" for k, (a, b) in enumerate(PAIRS, 1)) + ") AS t(doc_id, book, source, output))"
