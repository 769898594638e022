"""Each stage of the pipeline against brute force on what the one before it kept."""

import numpy as np
import pytest

import corpus_pipeline as P
from test_jaccard import brute
from test_texts import brute_hits
from textloom.llm import mixing, token_store, toxicity
from textloom.llm.common import cut
from textloom.llm.jaccard import Threshold


def shares(sizes, weights, cap):
    """Targets of the sources: what exceeds a source's cap is shared again among the others by weight."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes))}
    target, open_ = {}, set(sizes)
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        for s in full or open_:
            target[s] = cap * sizes[s] if full else level * w[s]
        open_ -= full or open_
    return target


def check_mix(before, after):
    """Each source's taken words are its target, give or take half of its longest document."""
    count = lambda t: len((t or "").split())
    sizes, taken, longest = {}, {}, {}
    for s, t in before:
        sizes[s] = sizes.get(s, 0) + count(t)
        longest[s] = max(longest.get(s, 0), count(t))
    for s, t in after:
        taken[s] = taken.get(s, 0) + count(t)
    for s, want in shares(sizes, mixing.WEIGHTS, mixing.CAP).items():
        assert abs(taken.get(s, 0) - want) <= longest[s] / 2 + 1, (s, want, taken.get(s, 0))


def test_mix_check():
    """A mix that takes too little, as the bound on copies let pass, fails."""
    docs = [(f"s{k % 4}", "w " * (20 + k % 7)) for k in range(80)]
    with pytest.raises(AssertionError):
        check_mix(docs, docs[:20])


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        kept[name] = docs = cut(stage(spark, docs, sf), name)
        assert name == "token_output" or docs.columns == columns
    rows = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in kept.items() if n != "token_output"}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    every = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(every, labels)
    texts = [(r.doc_id, r.text) for r in every.collect()]
    s = toxicity.scores(model, [t for _, t in texts])
    assert sorted(rows["toxicity"]) == sorted(x for x, y in zip(texts, s, strict=True) if y < toxicity.THRESHOLD)
    want = {i for i, _, c in brute(rows["toxicity"], 5, Threshold(80, 100)) if i == c}
    assert sorted(i for i, _ in rows["jaccard_join"]) == sorted(want)
    leaks = {i for i, _, n, *_ in brute_hits(rows["jaccard_join"], bench, 10) if n}
    assert sorted(str(i) for i, _ in rows["decontaminate"]) == sorted(str(i) for i, _ in rows["jaccard_join"] if str(i) not in leaks)
    copies = {i: 0 for i, _ in rows["decontaminate"]}
    for i, _ in rows["mix_sources"]:
        copies[i] += 1
    assert max(copies.values()) <= 3
    check_mix([(r.source, r.text) for r in kept["decontaminate"].collect()], [(r.source, r.text) for r in kept["mix_sources"].collect()])
    got = kept["token_output"].orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows["mix_sources"])
    assert (np.cumsum([r.n_tokens for r in got])[:-1] == [r.start for r in got][1:]).all()
    of = token_store.Encoder(token_store.vocabulary_path())
    assert [r.n_tokens for r in got] == [len(of.encode([t])[0]) // 4 + 1 for _, t in sorted(rows["mix_sources"])]


def test_stages_on_any_columns(spark, sf):
    """Columns named as the operators name theirs, nulls, repeated rows and empty tables."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    names = ["row", "r", "id", "_id", "n", "s1", "s2", "sk", "hits", "items", "n_words", "score", "predicted", "size", "target", "copies", "_text", "_rank", "_row", "lead", "a.b"]
    wide = docs.selectExpr("*", *[f"doc_id `{c}`" for c in names]).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    wide = wide.unionByName(wide.limit(3)).unionByName(wide.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    for name, stage in P.STAGES:
        out = stage(spark, wide, sf)
        assert out.count() > 0 and stage(spark, wide.where("false"), sf).count() == 0, name
        if name != P.STAGES[-1][0]:
            assert out.columns == wide.columns, name
            assert all(r["n"] == r["doc_id"] for r in out.where("doc_id IS NOT NULL").select("n", "doc_id").collect()), name
    kept = P.drop_near_copies(spark, wide, sf)
    assert kept.where("text IS NULL").count() == 2
    assert kept.where("doc_id IS NOT NULL AND trim(text) <> ''").groupBy("doc_id").count().where("count > 1").count() == 0


def test_batches_are_small_whatever_the_length_of_texts(spark):
    """Rows of a megabyte came in one Arrow batch of 40 MB, and more rows in a larger one."""
    from pyspark.sql import functions as F

    from textloom.llm.common import BATCH_BYTES, map_batches

    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('abcdefghij', 100000)").alias("text"))
    got = map_batches(docs, lambda b: {"rows": [len(b["text"])], "bytes": [b["text"].nbytes]}, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 40 and max(r.bytes for r in got) <= BATCH_BYTES + 1_100_000


def test_workers_give_memory_back(spark):
    """A worker that is idle after a task kept what the task had at most, which counts in the next stage."""
    import os
    import re

    from textloom.llm import common

    def work(b):
        held = [np.ones(100_000, np.uint8) for _ in range(3000)]
        np.pinned = held[-1]  # else the C library may shrink its heap by itself
        return {"pid": [os.getpid()], "size": [sum(map(len, held))]}

    row = common.map_batches(spark.range(0, 1, 1, 1), work, "pid long, size long").first()
    with open(f"/proc/{row.pid}/smaps_rollup") as f:
        now = int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024
    assert row.size == 300_000_000 and now < 200, now
