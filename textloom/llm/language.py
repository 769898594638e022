"""Language identification as the inference of a mixture of languages.

Each language has an interpolated letter trigram model. A text is a bag of units of a few consecutive
words; expectation-maximisation estimates in which proportions languages wrote its units. Which
languages a text holds at all is chosen by penalised likelihood: starting from all of them, the one of
the least share goes as long as half the log of the number of units (BIC) is worth more than what it
explains. The prediction is the language of the largest share, and the score is that share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, map_batches, table
from .symbols import BITS, OTHER, SPACE, streams

#: The bound of the labelled sample: texts of every language, chosen by a hash of their id.
SAMPLE = 1000
#: Ranges of prints that the sample is cut from, as a power of two.
PART_BITS = 12
UNIT_WORDS, STEPS, UNKNOWN = 3, 12, "und"
SIZE = 1 << 3 * BITS
PAD = 3


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (SIZE, languages): log likelihood of a letter, or a word's end, after two symbols


def _letters(s: np.ndarray) -> np.ndarray:
    """Whatever isn't a letter ends a word alike."""
    return np.where(s >= OTHER, SPACE, s).astype(np.int32)


def _codes(s: np.ndarray) -> np.ndarray:
    """Of each place: its symbol after the two before it; 0 where no word is."""
    a, b = np.r_[[0, 0], s[:-2]], np.r_[[0], s[:-1]]
    a = np.where(b == SPACE, SPACE, a)
    return np.where((s != SPACE) | (b != SPACE), (a << 2 * BITS) | (b << BITS) | s, 0)


def counts(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(SIZE, np.int64)
    for s, _, _ in streams(texts, PAD):
        out += np.bincount(_codes(_letters(s)), minlength=SIZE)
    out[0] = 0
    return out


def model_of(langs: list[str], counted: np.ndarray) -> Model:
    """Witten-Bell interpolation of trigrams, bigrams, single letters and chance."""
    out = np.zeros((SIZE, len(langs)), np.float32)
    n = 1 << BITS
    for k in range(len(langs)):
        c3 = counted[k].reshape(n, n, n).astype(float)
        p = np.full(n, 1 / n)
        for c in (c3.sum((0, 1)), c3.sum(0), c3):
            total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
            rest = np.where(total + kinds > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            p = rest * p + np.where(total + kinds > 0, c / np.maximum(total + kinds, 1), 0.0)
        out[:, k] = np.log(p).reshape(-1)
    out[0] = 0
    return Model(langs, out)


def _units(model: Model, s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of the units (units, languages) and the piece that each is of."""
    s = _letters(s)
    word = np.flatnonzero((s != SPACE) & (np.r_[[0], s[:-1]] == SPACE))
    if not len(word):
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64)
    piece = np.searchsorted(starts, word, "right") - 1
    first = np.searchsorted(piece, piece)
    at = (np.arange(len(word)) - first) % UNIT_WORDS == 0
    codes = _codes(s)
    return np.stack([np.add.reduceat(model.table[:, k][codes], word[at]) for k in range(len(model.langs))], 1), piece[at]


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, axis=0)


def _fit(lik: np.ndarray, first: np.ndarray, n: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (texts, languages) and log likelihoods; `lik` is sorted by text."""
    share = active / active.sum(1, keepdims=True)
    of = np.repeat(np.arange(len(n)), n)
    for _ in range(STEPS):
        r = share[of] * lik
        r /= r.sum(1, keepdims=True)
        share = _sum(r, first) / n[:, None]
    return share, _sum(np.log((share[of] * lik).sum(1)), first)


def mixtures(lik: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of the chosen languages for texts of n units each; `lik` has units' log likelihoods."""
    lik = np.exp(np.maximum(lik - lik.max(1, keepdims=True), -60).astype(float))
    out = np.zeros((len(n), lik.shape[1]))
    todo = np.arange(len(n))
    active = np.ones_like(out)
    first = np.r_[0, np.cumsum(n)[:-1]]
    share, ll = _fit(lik, first, n, active)
    while len(todo):
        less = active.copy()
        weakest = np.where(active > 0, share, np.inf).argmin(1)
        less[np.arange(len(todo)), weakest] = 0
        more_than_one = active.sum(1) > 1
        less[~more_than_one] = active[~more_than_one]
        new_share, new_ll = _fit(lik, first, n, less)
        better = more_than_one & (new_ll + 0.5 * np.log(n + 1) >= ll)
        out[todo[~better]] = share[~better]
        keep = np.repeat(better, n)
        lik, todo, n, active, share, ll = lik[keep], todo[better], n[better], less[better], new_share[better], new_ll[better]
        first = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and shares; UNKNOWN with 0 for a text without letters, and if no language was learned."""
    shares = np.zeros((len(texts), len(model.langs)))
    liks, owners = [], []
    for s, starts, places in streams(texts, PAD) if model.langs else ():
        lik, piece = _units(model, s, starts)
        liks.append(lik)
        owners.append(places[piece])
    if liks and len(owner := np.concatenate(owners)):
        which, n = np.unique(owner, return_counts=True)
        shares[which] = mixtures(np.concatenate(liks), n)
    found = shares.sum(1) > 0 if model.langs else np.zeros(len(texts), bool)
    best = shares.argmax(1) if model.langs else np.zeros(len(texts), int)
    score = np.round(np.where(found, shares.max(1, initial=0), 0.0), 9)
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, found, strict=True)], np.minimum(score, 1), shares


def sampled(known: DataFrame, sample: int) -> DataFrame:
    """The distinct doc_id and lang of the `sample` rows of each language with the smallest prints of their ids.

    Prints are counted in 1 << PART_BITS ranges first, so that only the ranges up to the sample's end are
    ranked, however many rows a language has. Repeated rows count as often; no rows give none.
    """
    place = F.xxhash64("doc_id")
    known = known.withColumn("_part", F.shiftright(place, 64 - PART_BITS))
    in_order = Window.partitionBy("lang").orderBy("_part")
    parts = known.groupBy("lang", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
    cuts = parts.where(F.col("_before") < sample).groupBy("lang").agg(F.max("_part").alias("_cut"))
    # a value for each language, which a model holds whole anyway
    cut_of = cuts.agg(F.map_from_entries(F.collect_list(F.struct("lang", "_cut")))).scalar()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    return known.where(F.col("_part") <= F.try_element_at(cut_of, F.col("lang"))).withColumn("_rank", rank).where(F.col("_rank") <= sample).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` ids of each language outside the held-out fold; only counts reach the driver."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = sampled(known, sample)
    rows = docs.select("doc_id", "lang", "text").where("text IS NOT NULL").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")

    def count(b: dict) -> dict:
        out: dict[str, list] = {"lang": [], "code": [], "n": []}
        of = np.array(b["lang"].to_pylist(), object)
        texts = b["text"].to_pylist()
        for lang in sorted(set(of)):
            c = counts([texts[k] for k in np.flatnonzero(of == lang)])
            at = np.flatnonzero(c)
            out["lang"] += [lang] * len(at)
            out["code"] += at.tolist()
            out["n"] += c[at].tolist()
        return out

    summed = map_batches(rows, count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    counted = np.zeros((len(langs), SIZE), np.int64)
    counted[np.searchsorted(langs, summed["lang"]) if langs else [], summed["code"].astype(int)] = summed["n"]
    return model_of(langs, counted)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and `shares`, an array of (lang, share) of the chosen languages.

    A null text, an empty one and one without letters are UNKNOWN with a score of 0 and no shares.
    Repeated rows give repeated results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: dict) -> dict:
        langs = shared.value.langs
        pred, score, shares = predict(shared.value, b["text"].to_pylist())
        held = [[{"lang": langs[k], "share": float(x[k])} for k in np.flatnonzero(x > 0)] for x in shares]
        return {"doc_id": b["doc_id"], "lang_pred": pred, "score": score, "shares": held}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, shares array<struct<lang: string, share: double>>")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
