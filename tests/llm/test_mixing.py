"""Mixing against a plain Python ranking, and near its targets."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from textloom.llm import mixing as M


def shares(size, weights, cap):
    """Targets by filling up: the plain rule."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * size[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = Fraction(cap * size[s])
            left -= target[s]
        open_ -= full
    return target


def brute(rows, weights=M.WEIGHTS, cap=M.CAP):
    """copies of every row; rows are (doc_id, source, size, key)."""
    size = defaultdict(int)
    for _, s, n, _ in rows:
        size[s] += n
    target, out = shares(size, weights, cap), {}
    for s in size:
        own = [r for r in rows if r[1] == s]
        whole = int(target[s] // size[s]) if size[s] else 0
        left = target[s] - whole * size[s]
        out |= {r[0]: whole for r in own}
        docs = sorted((r for r in own if r[2]), key=lambda r: -r[2])
        if left <= 0 or not docs:
            continue
        for k in range(len(docs)):  # the k longest are certain
            per = float((left - sum(r[2] for r in docs[:k])) / sum(r[2] ** 2 for r in docs[k:]))
            if per * docs[k][2] <= 1:
                break

        def rank(r, per=per):
            u, p = (r[3] % (1 << 52) + 0.5) / (1 << 52), min(1.0, per * r[2])
            odds = (u * (1 - p)) / ((1 - u) * p)
            return min(int(odds / (1 + odds) * (1 << M.BITS)), (1 << M.BITS) - 1)

        docs, cut = sorted(docs, key=rank), 0
        while cut < len(docs) and docs[cut][2] <= left:
            left -= docs[cut][2]
            out[docs[cut][0]] += 1
            cut += 1
        beyond = docs[cut:]
        for n in sorted({r[2] for r in beyond}, reverse=True):
            for r in [r for r in beyond if r[2] == n]:
                if n <= left:
                    left -= n
                    out[r[0]] += 1
                    beyond.remove(r)
        if beyond and (least := min(r[2] for r in beyond)) < 2 * left:
            out[next(r[0] for r in beyond if r[2] == least)] += 1
    return {i: min(k, cap) for i, k in out.items()}, target, size


def corpus(seed):
    r = random.Random(seed)
    out = []
    for k in range(700):
        s = r.choice(["a", "b", "hot", "hot", "hot", None, f"s{r.randrange(6)}"])
        n = r.choice([0, 1, 1, 2, 3, 8, 40, r.randrange(1, 60), r.randrange(1, 3000) if k % 9 == 0 else 5])
        out.append((k, " ".join(["w"] * n) if n else r.choice([None, "", " \t"]), s))
    return [*out, (9001, " ".join(["w"] * 9000), "lone"), (9002, "w", "lone"), (9003, None, "none")]


def test_against_plain_ranking(spark):
    for seed in (1, 2):
        df = spark.createDataFrame(corpus(seed), "doc_id long, text string, source string").repartition(3 + seed)
        keyed = M._sized(df).withColumn("key", F.xxhash64(F.lit(M.SEED), "doc_id", "_digest"))
        rows = [(r.doc_id, r.source, r.size, r.key) for r in keyed.collect()]
        want, target, size = brute(rows)
        got = M.mix(df).collect()
        assert {r.doc_id: r.copies for r in got} == want
        assert all(abs(r.target - target[r.source]) < 1e-6 * (1 + r.target) and r.source_size == size[r.source] for r in got)
        taken, least = Counter(), {}
        for r in got:
            taken[r.source] += r.copies * r.size
            whole = int(target[r.source] // size[r.source]) if size[r.source] else 0
            if r.size and r.copies <= whole and whole < M.CAP:
                least[r.source] = min(r.size, least.get(r.source, r.size))
        for s, words in target.items():
            if s in least or taken[s] < words:  # else the last that wasn't taken was nearer than none
                assert abs(taken[s] - words) <= least.get(s, 0) / 2 + 1e-6, s


def test_inclusion_differs_with_size(spark):
    """Of equally many short and long documents a source takes more of the long ones: ranks aren't random alone."""
    rows = [(k, " ".join(["w"] * (10 if k % 2 else 30)), s) for s, base in (("a", 0), ("b", 10_000)) for k in range(base, base + 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df).where("source = 'b'").groupBy("size").agg(F.sum(F.col("copies") % 2).alias("n")).collect()
    n = {r["size"]: r["n"] for r in got}
    assert 2.2 < n[30] / n[10] < 4.5


def test_nothing_and_repeats(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string, source string")
    assert M.mix(df.where("false")).count() == M.take(df.where("false")).count() == 0
    twice = df.unionByName(df.limit(50)).selectExpr("*", "1 size", "2 target", "3 _rank", "4 copies", "5 `a.b`")
    out = M.take(twice)
    assert out.columns == twice.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, M.take(twice.repartition(7)).collect()))
