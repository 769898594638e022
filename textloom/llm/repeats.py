"""Removal of repeated passages by longest previous factors.

A byte goes if a string of LEAST bytes covers it that also starts earlier (in a smaller document, or
earlier in the same one). Over one long text that is: the longest previous factor of the string's place
is at least LEAST long, and the previous or next smaller position in suffix order gives it. Documents
of a corpus don't meet in one suffix array, so suffixes are dealt so that equal ones meet:

1. Every window of LEAST bytes owns the smallest fingerprint of its K-byte grams, its anchor. Equal
   windows have equal anchors. Neighbouring windows share one, so there are few: about 3 in 100 bytes.
2. Occurrences of an anchor meet by its fingerprint, with a print of all bytes that its windows cover.
   Where all of those were there before, every window is a repeat. Anchors that occur once are done.
3. What is left are anchors whose surroundings differ, at the edges of repeats. The bytes around them
   come together by anchor; their suffixes are sorted up to LEAST bytes, by prefix doubling, ties by
   place. The previous and next smaller place of each in suffix order give its longest previous factor,
   and what factors of LEAST bytes cover goes. An anchor with very many different surroundings is not
   put into one array: its windows meet by their own prints instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, table
from .shingles import BYTE, FACTOR, mix

LEAST, GRAM = 100, 32
#: Bytes that a step works on, below 1 << PLACE_BITS; bytes of one suffix array; surroundings of one anchor in an array.
STEP, PLACE_BITS, ARRAY_BYTES, ARRAY_MOST = 2_000_000, 24, 2_000_000, 10_000
#: Bytes that the first ranks of suffixes compare at once.
WORD = 8
INVERSE = np.uint64(pow(int(FACTOR), -1, 2**64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x)]) for x in (FACTOR, INVERSE))


def _prefix(b: np.ndarray) -> np.ndarray:
    """Sums from which the print of any part follows."""
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum(BYTE[b] * _powers(2 * STEP)[0][: len(b)], dtype=np.uint64)]


def _prints(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((p[end] - p[start]) * _powers(2 * STEP)[1][start])


def anchors(b: np.ndarray, valid: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """print, place, first and last window start of every run of valid windows with one anchor."""
    n = len(b) - gram + 1
    p = _prefix(b)
    h = _prints(p, np.arange(n), np.arange(gram, n + gram))
    low = np.uint64((1 << PLACE_BITS) - 1)
    m = (h & ~low) | np.arange(n, dtype=np.uint64)
    width, have = least - gram + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    m = np.minimum(m[: n - width + 1], m[width - have : n - have + 1])[: len(valid)]
    new = np.r_[True, m[1:] != m[:-1]] | np.r_[True, valid[1:] != valid[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(valid)] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    place = (m[first] & low).astype(np.int64)
    return p, h[place], place, first, last


def _pieces(b: pa.RecordBatch, least: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of bounded size; pieces of one text overlap by least - 1 bytes."""
    out, size = [], 0
    for k, t in enumerate(b.column("_text")):
        t = t.as_py()
        for at in range(0, max(1, len(t) - least + 1), STEP):
            piece = t[at : at + STEP + least - 1]
            if len(piece) >= least:
                if size and size + len(piece) > STEP:
                    yield out
                    out, size = [], 0
                out.append((k, at, piece))
                size += len(piece)
    if out:
        yield out


def _docs(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("dig"), text.cast("binary").alias("_text"))


def _anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """h, ctx, id, dig, start, n: an anchor's print, that of the n bytes from start which its windows cover."""

    def run(batches):
        for batch in batches:
            ids, digs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "dig"))
            for part in _pieces(batch, least):
                b = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
                size = np.array([len(x[2]) for x in part])
                begin = np.r_[0, np.cumsum(size)[:-1]]
                valid = np.zeros(len(b) - least + 1, bool)
                for s, n in zip(begin.tolist(), size.tolist(), strict=True):
                    valid[s : s + n - least + 1] = True
                p, h, place, first, last = anchors(b, valid, least, gram)
                # runs don't span documents: a window that crosses their border isn't valid
                owner = np.searchsorted(begin, first, "right") - 1
                with np.errstate(over="ignore"):
                    ctx = mix(_prints(p, first, last + least) ^ mix((place - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64), 3))
                row = np.array([x[0] for x in part])[owner]
                start = first - begin[owner] + np.array([x[1] for x in part])[owner]
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "ctx": ctx.view(np.int64), "id": ids[row], "dig": digs[row], "start": start.astype(np.int64), "n": (last - first + least).astype(np.int32)})

    return _docs(docs).where(F.length("_text") >= least).mapInArrow(run, "h long, ctx long, id long, dig long, start long, n int")


def smaller_before(v: np.ndarray) -> np.ndarray:
    """For each place of `v`, all different, the nearest place before it that holds a smaller value, or -1.

    A tree of minima over pairs: up until a left sibling holds a smaller value, then down its right side.
    """
    levels = [v]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append(np.minimum(x[::2], np.r_[x[1::2], x[-1:]] if len(x) % 2 else x[1::2]))
    who = node = np.arange(len(v), dtype=np.int32)
    met = []
    for x in levels[:-1]:
        odd = np.flatnonzero(node & 1)
        hit = odd[x[node[odd] - 1] < v[who[odd]]]
        met.append((who[hit], node[hit] - 1))
        rest = np.ones(len(who), bool)
        rest[hit] = False
        who, node = who[rest], node[rest] >> 1
    who = node = np.zeros(0, np.int32)
    for k in range(len(met) - 1, -1, -1):
        who, node = np.r_[who, met[k][0]], np.r_[node, met[k][1]]
        if k:
            right = 2 * node + 1
            node = np.where(levels[k - 1][right] < v[who], right, right - 1)
    out = np.full(len(v), -1, np.int32)
    out[who] = node
    return out


def longest_previous_factors(texts: list[bytes], least: int) -> np.ndarray:
    """For each place of the texts, one after the other, how long a string from there also starts earlier.

    Lengths are known to the sizes that were ranked: WORD, doubled up to `least`; shorter ones are 0. Ranks
    of such prefixes give the suffix order, ties by place; every text ends in an end of its own, so no string
    leaves its text. Of all earlier places the previous and the next smaller one in suffix order share most.
    """
    b = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(n)), n)
    room = np.cumsum(n)[text] - np.arange(len(b))
    have = min(WORD, least)
    padded = np.r_[b, np.zeros(have, np.uint8)]
    key = np.zeros(len(b), np.uint64)
    for k in range(have):
        key = (key << np.uint64(8)) | padded[k : k + len(b)]
    short = np.flatnonzero(room < have)  # shares nothing that counts
    rank = np.unique(key, return_inverse=True)[1] + len(short)
    rank[short] = np.arange(len(short))
    ranks = [(have, rank.astype(np.int32))]
    while have < least:
        step = min(have, least - have)
        after = np.where(room > step, np.r_[rank[step:], np.zeros(min(step, len(b)), np.int64)] + len(n), text)
        rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1]
        have += step
        ranks.append((have, rank.astype(np.int32)))
    order = np.argsort(rank, kind="stable").astype(np.int32)
    sides = smaller_before(order), len(order) - 1 - smaller_before(order[::-1])[::-1]
    best = np.zeros(len(order), np.int32)
    for size, rank in ranks:
        r = rank[order]
        for near in sides:
            there = (near >= 0) & (near < len(order))
            best[there & (r[np.where(there, near, 0)] == r)] = size
    found = np.zeros(len(order), np.int32)
    found[order] = best
    return found


def previous_factors(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each text its places whose previous factor has `least` bytes, in this order of texts and places."""
    found = longest_previous_factors(texts, least) >= least
    n = np.array([len(t) for t in texts])
    return [np.flatnonzero(x) for x in np.split(found, np.cumsum(n)[:-1])]


def _runs(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Merged byte spans of windows at sorted starts."""
    if not len(starts):
        return []
    cut_ = np.flatnonzero(np.diff(starts) > least)
    return list(zip(starts[np.r_[0, cut_ + 1]].tolist(), (starts[np.r_[cut_, len(starts) - 1]] + least).tolist(), strict=True))


def _edges(marks: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """id, dig, s, e: repeats among anchors of several surroundings."""
    wanted = marks.where("first AND kinds > 1").groupBy("id", "dig").agg(F.collect_list(F.struct("h", "start", "n", "kinds")).alias("parts"))

    def around(batches):
        for b in batches:
            out: dict[str, list] = {"h": [], "id": [], "dig": [], "start": [], "bytes": [], "many": []}
            for i, d, t, parts in zip(*(b.column(c).to_pylist() for c in ("id", "dig", "_text", "parts")), strict=True):
                for x in parts:
                    out["h"].append(x["h"])
                    out["id"].append(i)
                    out["dig"].append(d)
                    out["start"].append(x["start"])
                    out["bytes"].append(t[x["start"] : x["start"] + x["n"]])
                    out["many"].append(x["kinds"] > ARRAY_MOST)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("dig", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary()), ("many", pa.bool_())])
    held = texts.join(wanted, ["id", "dig"]).select("id", "dig", "_text", "parts").mapInArrow(around, "h long, id long, dig long, start long, bytes binary, many boolean")
    held = cut(held, "repeats-around")

    def spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = sorted(dict.fromkeys(rows), key=lambda r: r[1:4])  # a row that repeats isn't an earlier document
        out = [(r[1], r[2], r[3] + s, r[3] + e) for r, starts in zip(rows, previous_factors([r[4] for r in rows], least), strict=True) for s, e in _runs(starts, least)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "dig", "s", "e"])

    def arrays(batches):
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "id", "dig", "start", "bytes")), strict=True):
                if size > ARRAY_BYTES and r[0] != rows[-1][0]:
                    yield from spans(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield from spans(rows)

    def windows(batches):
        for b in batches:
            for i, d, s, t in zip(*(b.column(c).to_pylist() for c in ("id", "dig", "start", "bytes")), strict=True):
                p = _prefix(np.frombuffer(t, np.uint8))
                at = np.arange(len(t) - least + 1)
                x = _prints(p, at, at + least)
                yield pa.RecordBatch.from_pydict({"x": x.view(np.int64), "y": [hashlib.blake2b(t[k : k + least], digest_size=8).digest() for k in at], "id": np.full(len(at), i), "dig": np.full(len(at), d), "s": at + s})

    few = held.where("NOT many").repartition("h").sortWithinPartitions("h").mapInArrow(arrays, "id long, dig long, s long, e long")
    many = held.where("many").mapInArrow(windows, "x long, y binary, id long, dig long, s long")
    place = F.struct("id", "dig", "s")
    least_ = F.min(place).over(Window.partitionBy("x", "y"))
    many = many.withColumn("f", least_).where(place != F.col("f")).select("id", "dig", "s", (F.col("s") + least).alias("e"))
    return few.unionByName(many)


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, `removed` (merged byte spans, end exclusive) and `kept` (the bytes that are left).

    Documents are in the order of their ids, null first; rows of one id by a print of their text, and
    rows of one id and text are one document, reported as often as it occurs. A null text is empty and
    keeps nothing; texts shorter than `least` bytes keep all. Other columns are ignored.
    """
    found = _anchors(docs, least, min(gram, least))
    place = F.struct("id", "dig", "start")
    alike, all_ = Window.partitionBy("h", "ctx"), Window.partitionBy("h")
    marks = found.withColumn("first", F.min(place).over(alike) == place).withColumn("kinds", F.sum(F.col("first").cast("int")).over(all_))
    marks = cut(marks.where("NOT first OR kinds > 1").select("h", "id", "dig", "start", "n", "first", "kinds"), "repeats-anchors")
    texts = _docs(docs)
    whole = marks.where("NOT first").select("id", "dig", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))
    spans = whole.unionByName(_edges(marks, texts, least)).groupBy("id", "dig").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def remove(batches):
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "removed": [], "kept": []}
            for t, spans in zip(b.column("_text"), b.column("spans").to_pylist(), strict=True):
                t, merged = t.as_py(), []
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                out["n_bytes"].append(len(t))
                out["removed"].append([{"s": s, "e": e} for s, e in merged])
                out["kept"].append(b"".join(t[a:z] for a, z in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(t)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["removed"], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(out["kept"], pa.binary())], ["id", "n_bytes", "removed", "kept"])

    ends = texts.join(spans, ["id", "dig"], "left").select("id", "_text", "spans").mapInArrow(remove, "id long, n_bytes long, removed array<struct<s: long, e: long>>, kept binary")
    return ends.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "removed", "kept")


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
