"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel compares two windows of a text by the letter triples that they share as subsequences; a
triple that spans s code points weighs DECAY**s, and s is at most SPAN, so letters that are inserted
between those of an insult, or left out, lower its weight but don't hide it. The end of a word counts as
one more letter. What is learned from are
labelled sentences seen as bags of windows: a clean text has clean windows only, a toxic one has at
least one toxic window, found anew in each round (multiple-instance learning).

The machine is linear in the landmarks' kernel values, and the kernel is a sum over triples, so the
landmarks fold into one weight for every triple. Scoring a text is a sum of table look-ups at every
code point, exactly the value of the kernel machine, and a text scores as its best window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import held_out, map_batches, table
from .symbols import BITS, SPACE, streams, symbols

SPAN, DECAY, WIDTH = 6, 0.7, 8
#: The bound of the labelled sample: texts of either label, chosen by a hash of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 4000
LANDMARKS, ROUNDS, WITNESSES, CLEAN_WINDOWS, REGULAR = 240, 3, 3, 4, 1e-3
THRESHOLD = 0.3
SIZE = 1 << 3 * BITS
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
REACH = WIDTH + SPAN
LAST_LETTER = 61
#: Cells in which runs of four letters are counted to find the first witnesses.
RUNS = 1 << 21


@dataclass
class Model:
    weights: np.ndarray  # (SPAN + 1, SIZE): of a triple by its span
    bias: float
    slope: float
    shift: float


def _folded(s: np.ndarray) -> np.ndarray:
    """All that isn't a letter ends a word alike; a triple may hold one such end."""
    return np.where(s > LAST_LETTER, SPACE, s).astype(np.int32)


def _codes(s: np.ndarray, gap: tuple[int, int], n: int) -> np.ndarray:
    a, b = gap
    return (s[:n] << 2 * BITS) | (s[a : a + n] << BITS) | s[a + b : a + b + n]


def best_windows(model: Model, s: np.ndarray) -> np.ndarray:
    """The value of the window that begins at each place; `s` ends with REACH spaces."""
    s = _folded(s)
    n = len(s) - SPAN + 1
    g = np.zeros(n, np.float32)
    for gap in GAPS:
        g += model.weights[sum(gap) + 1][_codes(s, gap, n)]
    g = g[:-1] + g[1:]
    g = g[:-2] + g[2:]
    return g[:-4] + g[4:]


def margins(model: Model, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), -np.inf)
    for s, starts, places in streams(texts, REACH, REACH):
        np.maximum.at(out, places, np.maximum.reduceat(best_windows(model, s), starts).astype(float))
    return out + model.bias


def scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    """Without a model (no labels of both kinds) every text scores 0."""
    if model is None:
        return np.zeros(len(texts))
    return np.round(1 / (1 + np.exp(-np.clip(model.slope * margins(model, texts) + model.shift, -30, 30))), 9)


# --- training, on a bounded sample


class Windows:
    """Windows as sparse triples: codes and weights, each (windows, WIDTH * gaps)."""

    def __init__(self, rows: np.ndarray):
        s = _folded(rows)
        codes = [_codes(s[:, k:].T, gap, 1)[0] for k in range(WIDTH) for gap in GAPS]
        self.codes = np.stack(codes, 1)
        weights = np.array([DECAY ** (sum(gap) + 1) for _ in range(WIDTH) for gap in GAPS], np.float32)
        parts = np.stack([self.codes >> 2 * BITS, self.codes >> BITS & 63, self.codes & 63])
        self.values = np.where((parts == SPACE).sum(0) <= 1, weights, np.float32(0))

    def dense(self, k: int) -> np.ndarray:
        return np.bincount(self.codes[k], self.values[k], SIZE).astype(np.float32)

    def against(self, vector: np.ndarray) -> np.ndarray:
        return (vector[self.codes] * self.values).sum(1)


def _cut(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    return s[at[:, None] + np.arange(REACH - 1)]


def _separated(value: np.ndarray, most: int) -> list[int]:
    """Places of the largest values, at least WIDTH apart, ties to the first."""
    out: list[int] = []
    for k in np.argsort(-value, kind="stable")[: 40 * most].tolist():
        if all(abs(k - x) >= WIDTH for x in out):
            out.append(k)
            if len(out) == most:
                break
    return out


def _first_witnesses(streams_of: list[np.ndarray], toxic: np.ndarray) -> list[list[int]]:
    """Places of the letter runs of four that most tell toxic texts from clean ones."""
    counts = np.zeros((2, RUNS), np.int32)

    def runs(s: np.ndarray) -> np.ndarray:
        x = s.astype(np.int32)
        n = max(0, len(x) - 3)
        c = (x[:n] << 18) | (x[1 : n + 1] << 12) | (x[2 : n + 2] << 6) | x[3 : n + 3]
        ok = np.logical_and.reduce([(x[k : n + k] > SPACE) & (x[k : n + k] <= LAST_LETTER) for k in range(4)])
        return np.where(ok, (c * np.int64(0x9E3779B1) >> 8) % (RUNS - 1) + 1, 0)

    for s, y in zip(streams_of, toxic, strict=True):
        counts[int(y), np.unique(runs(s))] += 1
    n1, n0 = toxic.sum(), (~toxic).sum()
    odds = lambda c: np.log((counts[1, c] + 0.5) / (n1 + 1)) - np.log((counts[0, c] + 0.5) / (n0 + 1))
    out = []
    for s, y in zip(streams_of, toxic, strict=True):
        c = runs(s) if y else np.zeros(0, np.int64)
        value = np.where((c > 0) & (counts[1, c] >= 3), odds(c), -1.0)
        out.append([k for k in _separated(value, WITNESSES) if value[k] > 1])
    return out


def _landmarks(w: Windows, m: int) -> list[int]:
    """Greedy k-centres in the kernel's distance, from the window of the largest norm."""
    norm = (w.values**2).sum(1)  # of windows without repeated triples, which is close enough to spread landmarks
    chosen = [int(np.argmax(norm))]
    near = np.full(len(norm), np.inf)
    while len(chosen) < min(m, len(norm)):
        k = chosen[-1]
        near = np.minimum(near, norm + norm[k] - 2 * w.against(w.dense(k)))
        nxt = int(np.argmax(near))
        if near[nxt] <= 1e-6:
            break
        chosen.append(nxt)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, regular: float) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], regular)
    ridge[-1] = 1e-8
    weight = weight / weight.sum()

    def loss(w):
        return (ridge * w * w).sum() / 2 + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(30):
        m = 1 - y * (x @ w)
        on = m > 0
        xa, wa = x[on], weight[on]
        gradient = ridge * w - 2 * xa.T @ (wa * y[on] * m[on])
        xa *= np.sqrt(wa * 2)[:, None].astype(x.dtype)
        step = np.linalg.solve(np.diag(ridge + 1e-10) + (xa.T @ xa).astype(float), gradient)
        t, now = 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-4:
            t /= 2
        w -= t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def train(texts: list[str], toxic: list[bool], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | None:
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    rng = np.random.default_rng(7)
    pad = np.zeros(REACH, np.uint8)
    seen = [np.concatenate([pad[:2], symbols(t), pad]) for t in texts]
    fit = np.arange(len(y)) % 5 != 0  # a fifth calibrates
    if not y[fit].any() or y[fit].all() or not y[~fit].any() or y[~fit].all():
        fit = np.ones(len(y), bool)
    fitted = np.flatnonzero(fit)
    place = _first_witnesses([seen[k] for k in fitted], y[fitted])
    positive = [_cut(seen[k], np.maximum(np.array(at) - 2, 0)) for k, at in zip(fitted, place, strict=True) if at]
    if not positive:
        return None
    clean = [k for k in fitted if not y[k]]
    negative = [_cut(seen[k], rng.integers(0, max(1, len(seen[k]) - REACH), CLEAN_WINDOWS)) for k in clean]
    hard: list[np.ndarray] = []
    model = None
    for _ in range(rounds):
        rows, n = np.unique(np.concatenate(positive), axis=0, return_counts=True)
        others = np.unique(np.concatenate([*negative, *hard]), axis=0)
        pos, neg = Windows(rows), Windows(others)
        some = np.sort(rng.permutation(len(rows))[:6000])
        marks = Windows(rows[some][_landmarks(Windows(rows[some]), landmarks * 3 // 4)])
        back = np.sort(rng.permutation(len(others))[:4000])
        back = others[back] if not hard else np.concatenate(hard)[:4000]
        clean_marks = Windows(back[_landmarks(Windows(back), landmarks // 4)])
        basis = [(w, k) for w in (marks, clean_marks) for k in range(len(w.codes))]
        k_pos, k_neg = (np.empty((len(r), len(basis)), np.float32) for r in (rows, others))
        gram = np.empty((len(basis), len(basis)))
        for j, (w, k) in enumerate(basis):
            one = w.dense(k)
            k_pos[:, j], k_neg[:, j] = pos.against(one), neg.against(one)
            gram[:, j] = np.concatenate([marks.against(one), clean_marks.against(one)])
        gram = (gram + gram.T) / 2
        values, vectors = np.linalg.eigh(gram)
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        scale = np.sqrt(np.trace(gram) / len(gram))
        x = np.vstack([k_pos, k_neg]) @ (root / scale).astype(np.float32)
        del k_pos, k_neg
        label = np.r_[np.ones(len(rows)), -np.ones(len(others))]
        weight = np.r_[n / n.sum(), np.full(len(others), 1 / len(others))]
        w = _svm(x, label, weight, REGULAR)
        flat = np.zeros(SIZE)
        for a, (m, k) in zip(root @ w[:-1] / scale, basis, strict=True):
            flat += a * m.dense(k)
        flat = flat.astype(np.float32)
        weights = np.stack([flat * np.float32(DECAY**s) if s >= 3 else np.zeros(SIZE, np.float32) for s in range(SPAN + 1)])
        model = Model(weights, float(w[-1]), 1.0, 0.0)
        positive, found = [], []
        for k in fitted:
            value = best_windows(model, seen[k]) + model.bias
            best = _separated(value, WITNESSES if y[k] else CLEAN_WINDOWS)
            if y[k]:
                positive.append(_cut(seen[k], np.array([b for j, b in enumerate(best) if not j or value[b] > 0])))
            else:
                found.append(_cut(seen[k], np.array([b for b in best if value[b] > -1] or best[:1])))
        hard = found
    check = np.flatnonzero(~fit) if not fit.all() else fitted
    m = margins(model, [texts[k] for k in check])
    return _calibrated(model, m, y[check])


def _calibrated(model: Model, m: np.ndarray, y: np.ndarray) -> Model:
    """A logistic curve over the margins (Platt), with targets drawn in from 0 and 1."""
    n1, n0 = y.sum(), (~y).sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones(len(m))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])
    return model


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[list[str], list[bool]]:
    """Labelled texts outside the held-out fold; at most `toxic` and `clean` ids, chosen by their hash.

    Labels without an id or a value don't count; an id with several labels is toxic if one is.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = F.broadcast(pick(True, toxic).unionByName(pick(False, clean)))  # toxic + clean rows at most
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    order = np.random.default_rng(3).permutation(len(rows))
    return [rows[k]["text"] for k in order], [bool(rows[k]["y"]) for k in order]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    return train(*sample(docs, labels))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 from THRESHOLD on).

    A null or empty text scores as a window of no letters. Repeated rows give repeated results. To carry
    columns of any name, keep only `row`, a struct of the whole row; the text is taken from it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = docs.select(*keep).schema.fields
    schema = StructType([*extra, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    within, text = keep == ("row",), "_text_of_op"

    def run(b: dict) -> dict:
        s = scores(shared.value, (b["row"].field("text") if within else b[text]).to_pylist())
        return {x.name: b[x.name] for x in extra} | {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return map_batches(docs.select("row") if within else docs.select(*keep, F.col("text").alias(text)), run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
