"""Every query against its SQL on DuckDB; the stack-shaped operators against literals."""

import os

import duckdb
import pytest

from textloom.operators import blocks
from textloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "as_tuple") else str(v)
    return sorted(tuple(map(norm, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name not in catalogue.ORACLE_SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, got)) == plain(want)


def test_rows():
    assert blocks.split_rows(r"a } & b \\ c & d") == ["a } & b ", " c & d"]
    assert len(blocks.split_rows(r"\thead{Total \\ Time} & \thead{Method}")) == 1
    assert len(blocks.split_rows(r"\begin{cases} a \\ b \end{cases} & x \\ y & z")) == 2


def test_spans():
    text, spans = blocks.protect("It costs $5 and $6 each. $x+y$ and $$a$$ [@k]")
    assert [s for _, s in spans] == ["$$a$$", "$x+y$", "[@k]"]
    assert blocks.restore(text, spans) == "It costs $5 and $6 each. $x+y$ and $$a$$ [@k]"


def test_page_numbers():
    assert blocks.page_numbers(["a", "1984", "b"]) == set()
    assert blocks.page_numbers(["1", "x", "2", "y", "99", "3", "4"]) == {0, 2, 5, 6}


def test_blocks():
    kinds = [k for k, _ in blocks.weld(blocks.parse("# H\n\npara\n\n```\n# no\n```\n\n![x](y.png)\n\nFigure 1: z\n\n- a\n  b\n- c\n\n> q\n\n| a | b |\n|---|---|"))]
    assert kinds == ["heading", "paragraph", "code_block", "figure", "list", "blockquote", "table"]
    assert blocks.pack([("heading", "# a"), ("paragraph", "x" * 70), ("heading", "# b"), ("paragraph", "y")], 100) == ["# a\n\n" + "x" * 70, "# b\n\ny"]


def test_references():
    from textloom.operators.references import bibliography, common_run

    doc = ["Prose here.", "# References", "[1] A. Author. Title. 1999.", "[2] B. Writer. Book. 2001.", "continued", "[3] C. Else. 2020.", "More prose in 1984 here."]
    assert bibliography(doc) == [False, False, True, True, True, True, False]
    assert bibliography(["Smith, J. said in 1990 so", "no", "no", "no", "no"]) == [False] * 5
    assert common_run("Accuracy of the model", "the model OF the model x") == 3


def test_roman(spark):
    from pyspark.sql import functions as F

    from textloom.functions.text import roman

    got = [r[0] for r in spark.range(1, 2025).select(roman(F.col("id"))).collect()]
    assert [got[k - 1] for k in (1, 4, 9, 14, 40, 90, 400, 1994, 2024)] == ["I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMXXIV"]


def test_advisor_totals(spark, sf):
    """Every document counts, and known sources without one have a row."""
    got = {r.source: r for r in catalogue.QUERIES["advisor_totals"](spark, sf).collect()}
    assert sum(r.n for r in got.values()) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == 25 and got["src24"].n == 0 and got["src24"].papers == 0 and got["src24"]["last"] is None
    assert all(0 < r.papers <= r.n for r in got.values() if r.n)


def test_neighbour_leaks(spark):
    """Copies of either neighbour count, with other line breaks too; what the own source holds doesn't."""
    from textloom.operators.gates import neighbour_leaks

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, 1, a, "x\n" + b[:90].replace(" ", "\n")), (1, 2, b, a[-100:].replace(" ", "  ")), (1, 3, c, b[-70:-20]), (2, 1, a, b), (2, 2, a + "\n" + b, b)]
    df = spark.createDataFrame(rows, "book long, k long, source string, output string")
    got = sorted((r.book, r.k, r.detail) for r in neighbour_leaks(df, "book", "k", "source", "output").collect())
    assert got == [(1, 1, "after"), (1, 2, "before")]


def test_packed_lines_of_several_chunks(spark, sf, monkeypatch):
    """The query's packing closes chunks, so that it shows what packing keeps."""
    made, chunks = [], blocks.chunks
    monkeypatch.setattr(blocks, "chunks", lambda *a, **k: made.append(chunks(*a, **k)) or made[-1])
    catalogue.QUERIES["packed_lines"](spark, sf)
    assert not made[0].groupBy("doc_id").count().where("count > 1").isEmpty()


def test_gates(spark):
    """What each gate says about the invented pairs."""
    from textloom.operators import gates, glossary
    from textloom.plans import fixtures

    pairs, K = fixtures.pairs(spark), ["doc_id"]
    found = lambda df, *cols: sorted((-r.doc_id, *(r[c] for c in cols)) for r in df.collect())
    assert found(gates.structure(pairs, K), "detail", "severity") == [(1, "headings", "warn"), (1, "list_items", "warn"), (1, "table_rows", "fail")]
    assert found(gates.fences(pairs, K)) == [(2,)]
    assert found(gates.untranslated(pairs, K)) == [(3,)]
    assert found(gates.commentary(pairs, K), "detail") == [(4, "opener"), (5, "note"), (6, "fenced")]
    assert found(gates.numerals(pairs, K), "detail") == [(7, n) for n in sorted(["58.9", "58.9%", "10ms", "60.000", "85Hz", "6.7"])]
    assert found(gates.images(pairs, K), "detail", "severity", "n") == [(9, "c.png", "fail", 1), (9, "d.png", "warn", 1), (9, "fig/a.png", "warn", 1), (9, "fig/b.png", "fail", 1)]
    assert found(glossary.left_untranslated(pairs, glossary.terms(spark).where("id LIKE 't%'"), K), "detail") == [(3, "t4"), (10, "t8")]
    assert found(gates.reference_verbatim(pairs.where("doc_id IN (-12, -13)"), K)) == [(13,)]
    quotes = spark.createDataFrame([(1, "a", "the ﬁrst  “part”"), (1, "b", "never there"), (1, "c", "short"), (1, "d", None)], "doc_id long, field string, quote string")
    chunks = spark.createDataFrame([(1, 'So the first "part"\nends')], "doc_id long, source string")
    assert found(gates.evidence(quotes, chunks, K), "field") == [(-1, "b")]


def test_gates_on_nulls_and_nothing(spark):
    """Null texts find nothing, rows that repeat are reported as often, an empty table stays empty."""
    from textloom.operators import gates, glossary

    pairs, K = spark.createDataFrame([(1, None, "x"), (2, "x 1.5", None), (3, "", ""), (None, None, None)], "doc_id long, source string, output string"), ["doc_id"]
    for rows, n in ((pairs, 0), (pairs.where("false"), 0)):
        for gate in (gates.structure, gates.fences, gates.commentary, gates.numerals, gates.untranslated, gates.reference_verbatim):
            assert gate(rows, K).count() == n
        assert glossary.left_untranslated(rows, glossary.terms(spark), K).count() == 0
    twice = spark.createDataFrame([(1, "1.5", "no")] * 2, "doc_id long, source string, output string")
    assert gates.numerals(twice, K).count() == 2


def test_term_selection(spark):
    """Own terms first, then the most frequent others by frequency and source, against plain Python."""
    import random

    from textloom.operators import glossary

    rng = random.Random(3)
    texts = [(k, " ".join(str(int(rng.paretovariate(0.4))) for _ in range(rng.randint(0, 150)))) for k in range(40)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    terms = glossary.terms(spark)
    local = glossary.frequencies(df, glossary.surfaces(terms), ["doc_id"])
    got = {}
    for r in glossary.select_terms(df, local, terms, ["doc_id"]).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.id, r.own, r.freq))
    forms = {r.id: (r.source, [r.source, *r.aliases]) for r in terms.collect()}
    count = {}
    for k, t in texts:
        words = (t or "").split()
        count[k] = {i: sum(words.count(f) for f in fs) for i, (_, fs) in forms.items()}
    freq = {i: sum(c[i] for c in count.values()) for i in forms}
    order = sorted(forms, key=lambda i: (-freq[i], forms[i][0], i))
    for k, _ in texts:
        own = [i for i in order if count[k][i]]
        want = [(i, True, freq[i]) for i in own] + [(i, False, freq[i]) for i in [i for i in order if i not in own][:20]]
        assert got[k] == want[:50]
    assert any(len(v) == 50 for v in got.values())


def test_protected(spark):
    texts = [(1, "a $x$ b [@k1; @k2] and $$y\n$$ \\(z\\)"), (2, None), (3, "")]
    rows = {r.doc_id: r for r in blocks.protected(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(rows[k].restored == t for k, t in texts) and len(rows[1].spans) == 4 and "$" not in rows[1].text


def test_texts(spark):
    from pyspark.sql import functions as F

    from textloom.functions import text as T

    one = lambda f, *rows: [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k long, t string").orderBy("k").select(f(F.col("t"))).collect()]
    assert one(T.strip_comments, r"a \% b % c" + "\n% d\ne", r"x \\% y", "a\\begin{comment}b\n\\end{comment}c", None, "") == [r"a \% b " + "\n\ne", "x \\\\", "ac", None, ""]
    keys = one(T.natural_key, "fig" + "9" * 30, "fig1" + "0" * 30, "fig010", "fig9", "Fig10")
    assert keys[3] < keys[2] == keys[4] < keys[0] < keys[1]
    assert spark.createDataFrame([(1, None, 'q"é')], "b long, c string, a string").select(T.canonical_json(["b", "c", "a"])).first()[0] == '{"a":"q\\"é","b":1,"c":null}'
    assert one(T.strip_comments, "x" * 200_000 + "%" + "y" * 200_000)[0] == "x" * 200_000


def test_readers(spark, tmp_path):
    """A torn line of JSON is dropped; prints are of the bytes; comments of a config file are skipped."""
    import hashlib

    from textloom.sources import tables

    (tmp_path / "log.jsonl").write_text('{"lang": "ko", "chunks": ["c1"], "failed": []}\n{"lang": "de", "chu\n')
    assert [(r.lang, r.chunks) for r in tables.json_lines(spark, str(tmp_path / "log.jsonl")).collect()] == [("ko", ["c1"])]
    (tmp_path / "a.bin").write_bytes(b"\x00\xffx")
    got = tables.source_fingerprint(spark, str(tmp_path / "a.bin")).first()
    assert (got.sha256, got.length) == (hashlib.sha256(b"\x00\xffx").hexdigest(), 3)
    (tmp_path / "c.conf").write_text("# a=b\n\nlang = ko\nx=1=2\n")
    assert sorted(map(tuple, tables.config(spark, str(tmp_path / "c.conf")).collect())) == [("lang", "ko"), ("x", "1=2")]
