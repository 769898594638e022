"""Sets of word shingles as sorted 64-bit fingerprints, by whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A-Z to a-z; words end at the bytes 9-13 and 32.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STEP = 500_000
_rng = np.random.default_rng(20_240_901)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits that depends on the seed."""
    with np.errstate(over="ignore"):
        x = x ^ (np.uint64(seed) * FACTOR)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_prints(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(start):
        return np.zeros(0, np.uint64)
    word = np.cumsum(np.bincount(start, minlength=len(b)))[inside] - 1
    at = np.flatnonzero(inside)
    place = at - start[word]
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(place.max()), FACTOR)])
        first = np.searchsorted(word, np.arange(len(start)))
        return mix(np.add.reduceat(BYTE[b[at]] * power[place], first))


def word_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, in order, and how many each text has."""
    out, n = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        if held:
            out.append(_word_prints(b" ".join(held)))
            held.clear()

    size = 0
    for k, text in enumerate(texts):
        text = text.translate(FOLD)
        n[k] = len(text.split()) if len(text) < STEP else sum(1 for _ in text.split())
        at = 0
        while len(text) - at > STEP:  # cut a very long text where a word ends
            end = text.rfind(b" ", at, at + STEP) + 1 or text.find(b" ", at + STEP) + 1 or len(text)
            flush()
            size = 0
            out.append(_word_prints(text[at:end]))
            at = end
        held.append(text[at:])
        owners.append(k)
        size += len(held[-1])
        if size > STEP:
            flush()
            size = 0
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64), n


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Of each text the sorted fingerprints of its different shingles of `words` words.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    prints, n = word_prints(texts)
    total = len(prints)
    code = np.zeros(max(0, total - words + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            code += prints[j : total - words + 1 + j] * PLACE[j]
        code = mix(code, words)
        at = 0
        for k in n.tolist():
            if k >= words:
                yield np.unique(code[at : at + k - words + 1])
            elif k:
                short = np.uint64(0)
                for j in range(k):
                    short = short + prints[at + j] * PLACE[j]
                yield mix(np.array([short]), 1000 + k)
            else:
                yield np.zeros(0, np.uint64)
            at += k
