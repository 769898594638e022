"""Editions with nulls, repeats and nothing at all."""

from textloom.operators import editions


def test_apart_and_shared(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (3,)], "k long").selectExpr("*", "'x' side", "1 _a")
    b = spark.createDataFrame([(3,), (4,), (4,)], "k long")
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got(editions.apart(a, b, ["k"])) == [(1, "a"), (4, "b"), (None, "a")]
    assert got(editions.shared(a, b, ["k"])) == [(3,)]
    assert got(editions.apart(a, b.where("false"), ["k"])) == [(1, "a"), (3, "a"), (None, "a")]
    assert editions.shared(a, b.where("false"), ["k"]).count() == 0


def test_line_changes(spark):
    rows = [(1, "x\ny\ny\nz", "y\nx\nw"), (2, None, "q"), (3, "same", "same"), (4, "", None)]
    df = spark.createDataFrame(rows, "k long, s string, t string").selectExpr("*", "'c' line", "'d' side")
    got = sorted(map(tuple, editions.line_changes(df, ["k"], "s", "t").collect()))
    assert got == [(1, "w", 1, "b"), (1, "y", 2, "a"), (1, "z", 1, "a"), (2, "q", 1, "b"), (4, "", 1, "a")]
    assert editions.line_changes(df.where("false"), ["k"], "s", "t").count() == 0
