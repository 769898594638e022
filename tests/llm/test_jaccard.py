"""The Jaccard join against all pairs."""

import random
import re

import numpy as np

import corpus_pipeline as P
from textloom.llm import jaccard
from textloom.llm.common import NULL_ID
from textloom.llm.components import components
from textloom.llm.jaccard import Threshold, join


def brute(rows, words, t):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    ids = [NULL_ID if i is None else i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * t.of >= len(x | y) * t.at:
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets, strict=True))


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for g in range(30):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 11, 14, 30, 60, 150]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                k = r.randrange(len(w) or 1)
                w[k : k + 1] = r.choice([[], [*w[k : k + 1], "x"], [r.choice(vocabulary)]])
            out.append(" ".join(w))
    return out + [None, "", "  \n", "a", "A", "a b", "b a", "ﬁ é", "É é"]


def test_join(spark, sf):
    for seed, words, t in ((1, 3, Threshold(90, 100)), (2, 5, Threshold(80, 100)), (3, 2, Threshold(60, 100))):
        rows = [(3 * k + 7, x) for k, x in enumerate(corpus(seed))]
        random.Random(seed).shuffle(rows)
        rows += [(None, rows[0][1]), rows[1], (rows[2][0], rows[2][1])]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' n", "1 id", "'y' s1", "2 key")
        got = sorted((r.id, r.n_shingles, r.component) for r in join(df, words, t).collect())
        assert got == brute(rows, words, t)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in real.collect()]
    for words, t in ((3, Threshold(90, 100)), (5, Threshold(80, 100))):
        assert sorted(map(tuple, join(real, words, t).collect())) == brute(rows, words, t)
    assert join(real.where("false")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(160, 100), (7, 7), (500, 499)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 161)} | {499: 499, 500: 499}


def test_star_of_copies(spark):
    """Copies that link only with the text they were made from, whose id is the largest."""
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: 4 + k], "x", *base[5 + k :]])) for k in range(0, 100, 2)] + [(900, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = Threshold(95, 100)
    assert sorted(map(tuple, join(df, 3, t).collect())) == brute(rows, 3, t)


def crowd(seed, m, n, most):
    """Near copies of one text that all differ, few of them linked with it, and unrelated texts."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(n)]
    out = []
    for k in range(m):
        w = list(base)
        for _ in range(r.randrange(0, most)):
            w[r.randrange(n)] = f"v{r.randrange(10**6)}"
        out.append((k * 7 % 100_003, " ".join(w)))
    return out + [(200_000 + k, " ".join(f"u{k}_{j}" for j in range(100))) for k in range(20)]


def test_voronoi_cells(spark, monkeypatch):
    """Regions that are split by pivots, within a task and between tasks, and compared tile by tile."""
    for region, leaf, shrink, rows in ((60, 8, 0.7, crowd(1, 200, 150, 12)), (40, 8, 0.95, crowd(2, 90, 1200, 120)), (4096, 64, 0.7, crowd(3, 150, 60, 5))):
        monkeypatch.setattr(jaccard, "REGION", region)
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        monkeypatch.setattr(jaccard, "SHRINK", shrink)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for words, t in ((3, Threshold(90, 100)), (5, Threshold(80, 100))):
            assert sorted(map(tuple, join(df, words, t).collect())) == brute(rows, words, t)


def test_windows_are_lossless():
    """Sketches never differ in more places than sets in shingles; linked sets share the nearest pivot's cell."""
    r, t = np.random.default_rng(1), Threshold(80, 100)
    base = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
    sets = [base]
    for k in range(200):
        sets.append(np.unique(np.r_[r.permutation(base)[: len(base) - k], r.integers(0, 2**63, k // 2).astype(np.uint64)]))
    v = jaccard._folded([jaccard.sketch(x, t) for x in sets])
    near = jaccard._within(v, v[[0, 40, 90, 150]], t.differ(300))
    home = jaccard._distances(v, v[[0, 40, 90, 150]]).argmin(1)
    assert not near.all() and near.any(1).all()
    for i in range(0, 201, 7):
        for j in range(201):
            differ = len(np.setxor1d(sets[i], sets[j]))
            assert np.bitwise_count(v[i] ^ v[j]).sum() <= differ
            inter = len(np.intersect1d(sets[i], sets[j]))
            assert t.near(differ, len(sets[i]), len(sets[j])) == (inter * 100 >= 80 * (len(sets[i]) + len(sets[j]) - inter))
            if t.near(differ, len(sets[i]), len(sets[j])):
                assert near[j, home[i]]


def test_ids_of_several_texts(spark):
    """Rows without an id, or that share one, are linked by their texts only; the pipeline loses no other text."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = lambda x: x + " more"
    rows = [(None, a), (None, b), (None, ""), (None, None), (1, near(a)), (2, near(b)), (5, c), (5, d), (6, near(d)), (7, ""), (7, " "), (8, "z y x w v u"), (None, "p q r s t u"), (None, "p q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.component) for r in join(df).collect()]
    by_id = {i: c for i, c in got if i not in (NULL_ID, 5)}
    assert by_id == {1: 1, 2: 2, 6: 6, 7: 7, 8: 8}
    assert sorted(c for i, c in got if i == NULL_ID)[:4] == [NULL_ID, NULL_ID, 1, 2]
    lone = [c for i, c in got if i == NULL_ID and c not in (NULL_ID, 1, 2)]
    assert len(lone) == 2 and lone[0] == lone[1] > 8
    assert sorted(c for i, c in got if i == 5)[0] == 6 and max(c for i, c in got if i == 5) not in (5, lone[0])
    kept = [tuple(r) for r in P.drop_near_copies(spark, df, "").collect()]
    want = [(None, ""), (None, None), (1, near(a)), (2, near(b)), (5, c), (6, near(d)), (7, ""), (7, " "), (8, "z y x w v u"), (None, "p q r s t u")]
    assert sorted(map(str, kept)) == sorted(map(str, want))
