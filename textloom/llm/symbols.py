"""Texts as streams of 6-bit symbols, for kernels and n-gram models that run over whole batches.

A symbol is 0 for white space, 1 to 26 for a letter a to z in either case, 27 to 61 for any other letter
(by its code point in lower case), and 62 for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

BITS, SPACE, OTHER = 6, 0, 62
FIRST_OTHER_LETTER, OTHER_LETTERS = 27, 35
#: Code points that a step works on at once.
STEP = 1_000_000


def _symbol(c: str) -> int:
    if c.isspace() or c == "\0":
        return SPACE
    low = c.lower()[0]
    if "a" <= low <= "z":
        return ord(low) - 96
    return FIRST_OTHER_LETTER + ord(low) * 7 % OTHER_LETTERS if c.isalpha() else OTHER


@cache
def _table() -> np.ndarray:
    return np.array([_symbol(chr(k)) for k in range(1 << 16)], np.uint8)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table()[np.minimum(points, 0xFFFF)]
    for k in np.flatnonzero(points > 0xFFFF).tolist():
        out[k] = _symbol(chr(points[k]))
    return out


def streams(texts: list[str | None], pad: int, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of bounded size: symbols with `pad` spaces after each piece, the pieces' starts, the texts' places.

    A text of over STEP code points comes in pieces, each of which repeats `overlap` of the one before.
    """
    pieces: list[str] = []
    places: list[int] = []
    size = 0

    def step():
        joined = symbols(("\0" * pad).join(pieces) + "\0" * pad)
        starts = np.cumsum([0] + [len(p) + pad for p in pieces[:-1]])
        return joined, starts, np.array(places)

    for k, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            pieces.append(text[at : at + STEP])
            places.append(k)
            size += len(pieces[-1]) + pad
            if size >= STEP:
                yield step()
                pieces, places, size = [], [], 0
            if at + STEP >= len(text):
                break
            at += STEP - overlap
    if pieces:
        yield step()
