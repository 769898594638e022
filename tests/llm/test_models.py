"""Models on held-out texts, neighbours against brute force, files by exact round trip, mixes by their totals."""

import random
import zlib

import numpy as np
import pytest

from textloom.llm import language, mixing, neighbours, repeats, token_store, toxicity


def test_toxicity_gaps():
    r = random.Random(1)
    words = [a + b for a in ("ti", "on", "er", "th", "re", "an") for b in ("an", "es", "ly", "or", "ed", "st")]
    sentence = lambda: [r.choice(words) for _ in range(r.choice([4, 12, 40]))]
    texts, toxic = [], []
    for k in range(600):
        s, bad = sentence(), k % 3 == 0
        if bad:
            s.insert(r.randrange(len(s)), r.choice(["blockhead", "numbskull"]))
        texts.append(" ".join(s) + ".")
        toxic.append(bad)
    model = toxicity.train(texts, toxic, landmarks=40, rounds=2)
    plain = [" ".join(sentence()) for _ in range(50)]
    odd = ["an ti block-head er", "th numb.skull re", "an b-l-o-ckhead or", "NUMBSKULL", "er blockkhead th"]
    s = toxicity.scores(model, plain + odd + ["", None])
    assert (s[:50] < 0.3).mean() > 0.9 and (s[50:55] >= 0.3).sum() >= 4 and (s[55:] < 0.3).all()
    assert toxicity.train(["a"], [True]) is None and (toxicity.scores(None, ["x", None]) == 0).all()
    long = "er th " * 400_000 + "blockhead"
    assert toxicity.scores(model, [long])[0] >= 0.3


def test_language():
    en, fr = ["the cat sat with that thing and they went there"] * 5, ["le chat est avec une chose que vous avez ici"] * 5
    model = language.model_of(["en", "fr"], np.stack([language.counts(en), language.counts(fr)]))
    pred, score, shares = language.predict(model, ["the thing that went", "une chose avec le chat", None, "", "123 !?", en[0] * 3 + " " + fr[0] * 2, "the cat " * 200_000])
    assert pred == ["en", "fr", "und", "und", "und", "en", "en"]
    assert score[2] == score[4] == 0 and (shares[5] > 0.2).all() and shares[0].min() == 0
    assert language.predict(language.model_of([], np.zeros((0, language.SIZE), np.int64)), ["a", None])[0] == ["und", "und"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.op2_language(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    x[100:200] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0, None] * 4), (None, [1.0] * 8), (1200, [1.0, 2.0]), (50, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' v", "1 ids")
    got = {}
    for r in neighbours.nearest(df, shard=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        sim = np.round(unit @ unit[q], 12)
        want = [k for k in np.lexsort((np.arange(600), -sim)) if k != q][:5]
        hit += len(set(want) & set(got[q]))
    assert set(got) == set(range(0, 600, 50)) and hit / 60 >= 0.9
    assert got[100] == [101, 102, 103, 104, 105] and got[150] == [100, 101, 102, 103, 104]
    assert neighbours.nearest(df.where("false")).count() == 0


def test_token_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(token_store.vocabulary_path())
    rows = [(5, "The cat, THE cat.\tÉtat d'été 12"), (3, None), (None, "null id"), (9, "<|endoftext|> x\x1cy z  w"), (5, "again"), (7, ""), (8, "long words " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' ids", "2 n")
    got = token_store.stored(df).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = of.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_store.stored(df.where("false")).count() == 0
    path = f"{tmp_path}/a.tlt"
    w = token_store.Writer(path, frame_bytes=64)
    for k in range(50):
        w.add(k, np.arange(k, dtype="<u4").tobytes())
    w.close()
    r = token_store.Reader(path)
    assert len(r.frames) > 5 and all(r.read(k) == np.arange(k, dtype="<u4").tobytes() for k in (49, 0, 17)) and r.find(17) == [17]
    raw = bytearray(open(path, "rb").read())
    raw[int(r.frames[2]["place"]) + 9] ^= 1
    open(path, "wb").write(bytes(raw))
    with pytest.raises(ValueError):
        token_store.Reader(path).frame(2)


def test_mix(spark):
    r = random.Random(4)
    rows = [(k, "w " * r.choice([1, 5, 30]), r.choice(["a", "a", "a", "b", "c", None])) for k in range(2000)] + [(5000, None, "a"), (5001, "", None), (None, "x y", "b"), (7, "w w", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 size", "2 target")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 3).all()
    total = got["size"].sum()
    by = {s: g for s, g in got.groupby(got["source"].fillna("~"))}
    w = dict(zip(sorted(by), (5, 2, 1, 5, 2), strict=False))
    level = sum(g["target"].iloc[0] for g in by.values())
    assert abs(level - total) < 1e-6 * total
    for g in by.values():
        goal = g["target"].iloc[0]
        assert goal <= 3 * g["size"].sum() + 1e-6 and abs((g["copies"] * g["size"]).sum() - goal) <= 30
    free = [g["target"].iloc[0] / w[s] for s, g in by.items() if g["target"].iloc[0] < 3 * g["size"].sum() - 1e-6]
    assert max(free) - min(free) < 1e-6 * total
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, got.values.tolist()))
    assert mixing.take(df).count() == got["copies"].sum() and mixing.mix(df.where("false")).count() == 0


def test_language_sample(spark):
    """The ids of the smallest prints of each language, as one window over all its rows gives them."""
    rows = [(k % 700, "ab"[k % 700 % 3 > 0]) for k in range(900)] + [(-1, "c")]
    known = spark.createDataFrame(rows, "doc_id long, lang string")
    prints = known.selectExpr("lang", "xxhash64(doc_id) AS p", "doc_id").collect()
    for sample in (1, 7, 250, 2000):
        want = {(r.doc_id, lang) for lang in "abc" for r in sorted((x for x in prints if x.lang == lang), key=lambda r: (r.p, r.doc_id))[:sample]}
        got = [(r.doc_id, r.lang) for r in language.sampled(known, sample).collect()]
        assert len(got) == len(want) and set(got) == want
    assert language.sampled(known.where("false"), 5).count() == 0


def test_previous_factors():
    """Lengths down to the sizes that are ranked, against every earlier place; strings end with their text."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        v = rng.permutation(rng.integers(1, 60))
        assert repeats.smaller_before(v.astype(np.int32)).tolist() == [max((j for j in range(k) if v[j] < v[k]), default=-1) for k in range(len(v))]
        least = int(rng.choice([1, 3, 8, 9, 12, 20]))
        texts = [bytes(rng.choice(list(b"ab\0"), rng.integers(1, 35))) for _ in range(rng.integers(1, 4))]
        texts.append(texts[0][-20:] + texts[-1][:15])
        sizes = [min(repeats.WORD, least)]
        while sizes[-1] < least:
            sizes.append(min(least, 2 * sizes[-1]))
        ends = [t[k:] for t in texts for k in range(len(t))]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [max((common(ends[j], ends[k]) for j in range(k)), default=0) for k in range(len(ends))]
        assert repeats.longest_previous_factors(texts, least).tolist() == [max((z for z in sizes if z <= w), default=0) for w in want]


def test_repeats(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.choice([2, 5, 9])))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(r.choice([2, 20, 60]))) for _ in range(3)]
        parts.insert(r.randrange(4), r.choice(passages))
        rows.append((k * 2, " ".join(parts)))
    rows += [(201, rows[3][1]), (1, rows[4][1]), (300, "ab" * 400), (301, None), (302, ""), (303, "x" * 99), (None, passages[0]), (304, passages[1] + "!"), (304, passages[1] + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' id", "1 h")
    for most in (repeats.ARRAY_MOST, 2):
        old, repeats.ARRAY_MOST = repeats.ARRAY_MOST, most
        got = {str(x.doc_id): ([(s.s, s.e) for s in x.removed], bytes(x.kept)) for x in repeats.repeats(df).collect()}
        repeats.ARRAY_MOST = old
        seen, want = set(), {}
        for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
            b = (t or "").encode()
            mark = bytearray(len(b))
            for k in range(len(b) - 99):
                if b[k : k + 100] in seen:
                    mark[k : k + 100] = b"\1" * 100
                seen.add(b[k : k + 100])
            want[str(i)] = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        assert {k: v[1] for k, v in got.items()} == want
    assert repeats.repeats(df.where("false")).count() == 0
