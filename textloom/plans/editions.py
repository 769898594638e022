"""Queries that compare two editions."""

from __future__ import annotations

from textloom.operators import editions

from .catalogue import PAIRS, _docs, _turns, query, table


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'a' ELSE 'b' END AS side FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def editions_apart(spark, sf):
    """Documents without a label and labels without a document."""
    return editions.apart(_docs(spark, sf), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def editions_shared(spark, sf):
    return editions.shared(_docs(spark, sf), table(spark, sf, "labels"), ["doc_id"])


_SIDE = "SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn, line) AS ordinal FROM (SELECT conv_id, turn, unnest(string_split({}, chr(10))) AS line FROM {})"


@query(
    f"SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, coalesce(a.line, b.line) AS line, coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN b.line IS NULL THEN 'a' ELSE 'b' END AS side"
    f" FROM ({_SIDE.format('source', PAIRS)}) a FULL JOIN ({_SIDE.format('output', PAIRS)}) b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.line = b.line AND a.ordinal = b.ordinal WHERE a.line IS NULL OR b.line IS NULL"
)
def line_changes(spark, sf):
    """Lines that a turn or its answer holds alone."""
    return editions.line_changes(_turns(spark, sf), ["conv_id", "turn"], "source", "output")
