"""First uses of words: against plain Python on odd texts, rows that share an id, and without a shuffle of words."""

import re

import pytest

from textloom.operators import glossary

TEXTS = ["The the THE cat", "", None, "ſK É é İx Ünï xKy\x00z", "a", "b", "end", "start a-b_c 1d2e", "  ", "漢字abc漢ABC", "x" * 300 + " x", "tail\n"]
ROWS = [(k, t) for k, t in enumerate(TEXTS * 5)] + [(3, "y x The"), (3, "The"), (0, "cat"), (None, "one two"), (None, "two one"), (1, None)]


def want(rows):
    out = {}
    for k, t in rows:
        for n, w in enumerate(re.findall("[A-Za-z]+", t or "")):
            out[k, w.lower()] = min(n, out.get((k, w.lower()), n))
    return sorted(((k, w, n) for (k, w), n in out.items()), key=str)


@pytest.mark.parametrize("piece", [1, 40, 2_000_000])
def test_pieces(piece, monkeypatch):
    """However a batch is cut, and where it is itself a part of a longer array."""
    import pyarrow as pa

    monkeypatch.setattr(glossary, "PIECE", piece)
    texts = pa.array(["before", *(t for _, t in ROWS), "after"])[1:-1]
    got = [x for r, w, p in glossary._new_words(texts) for x in zip(r.to_pylist(), w.to_pylist(), p.to_pylist(), strict=True)]
    assert sorted(got, key=str) == want((k, t) for k, (_, t) in enumerate(ROWS))
    assert not list(glossary._new_words(pa.array([None, ""], pa.string()))) and not list(glossary._new_words(pa.array([], pa.string())))


@pytest.mark.parametrize("most", [0, 2, 200_000])
def test_rows_that_share_an_id(spark, monkeypatch, most):
    monkeypatch.setattr(glossary, "BROADCAST_IDS", most)
    df = glossary.first_uses(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5))
    assert df.columns == ["doc_id", "gloss", "first_place"]
    assert sorted(map(tuple, df.collect()), key=str) == want(ROWS)


def test_words_are_not_shuffled(spark, sf):
    from textloom.plans import catalogue

    plan = catalogue.QUERIES["gloss_first_use"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
