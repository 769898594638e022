"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows. Every window holds shingles; a document that contains the window contains
all of them, so for exact containment a prefix of one shingle is necessary: the window's rarest, by the
number of documents that hold it. Documents look up prefix shingles only, bound the window's place by
the shingle's place in it (it has to begin and end within the document), and verify it word by word.

The index of the items is bounded: items are taken in blocks of at most BLOCK_BYTES of text, and each
block is joined with all documents. Documents aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_batches, table, texts_of, with_text

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 8_000_000
#: An odd factor; prints of runs of words wrap around at 64 bits.
SPREAD = np.int64(0x2545F4914F6CDD1D)
#: A-Z to a-z, every other ASCII byte outside 0-9 and a-z to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Items:
    """The windows of a block of items, as word ids, and their shingles."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in rows:
            w = [self.ids.setdefault(x, len(self.ids)) for x in words_of(text)]
            for k in range(max(1, len(w) - window + 1)) if w else ():
                windows[tuple(w[k : k + window])].add(item)
        self.windows = [(np.array(w, np.int64), sorted(names)) for w, names in windows.items()]
        #: By shingle length: shingle -> the windows that hold it and where.
        self.shingles: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (w, _) in enumerate(self.windows):
            k = min(SHINGLE, len(w))
            for at, s in enumerate(self.codes(w, k).tolist()):
                self.shingles[k][s].append((n, at))
        self.shingles = {k: dict(v) for k, v in self.shingles.items()}

    def codes(self, w: np.ndarray, k: int) -> np.ndarray:
        """Prints of all runs of k words; -1 where a word isn't an item's. Runs of one print are told apart by verification."""
        n = len(w) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            x = w[j : j + n]
            code = code * SPREAD + x
            known &= x >= 0
        code &= np.int64(2**63 - 1)
        code[~known] = -1
        return code

    def read(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))

    def held(self, w: np.ndarray) -> Iterator[tuple[int, int]]:
        """The different shingles of the items that a document holds, with their length."""
        for k in self.shingles:
            c = self.codes(w, k)
            for s in np.unique(c[c >= 0]).tolist():
                if s in self.shingles[k]:
                    yield k, s

    def index(self, counts: dict[tuple[int, int], int]) -> None:
        """Keeps of each window its rarest shingle; ties go to the smaller code, then the first place."""
        best: dict[int, tuple] = {}
        for k, table in self.shingles.items():
            for s, places in table.items():
                for n, at in places:
                    best[n] = min(best.get(n, (2**63,)), (counts.get((k, s), 0), s, at, k))
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, s, at, k) in best.items():
            self.prefixes[k][s].append((n, at))
        self.prefixes = {k: dict(v) for k, v in self.prefixes.items()}
        self.sorted = {k: np.array(sorted(v), np.int64) for k, v in self.prefixes.items()}
        self.shingles = {}

    def found(self, w: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Where windows stand in a document, as (start, end), and the items that they are of."""
        spans, names = set(), set()
        for k, keys in self.sorted.items():
            c = self.codes(w, k)
            at = np.flatnonzero(c >= 0)
            if len(at):
                x = c[at]
                at = at[keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x]
            for i in at.tolist():
                for n, off in self.prefixes[k][int(c[i])]:
                    words, own = self.windows[n]
                    start = i - off
                    if start >= 0 and start + len(words) <= len(w) and np.array_equal(w[start : start + len(words)], words):
                        spans.add((start, start + len(words)))
                        names.update(own)
        return sorted(spans), names


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[Items]:
    rows, size = [], 0
    for r in with_text(items.where("item_id IS NOT NULL"), "item_id").toLocalIterator():
        rows.append((str(r["item_id"]), bytes(r["_text"])))
        size += len(rows[-1][1])
        if size >= block_bytes:
            yield Items(rows, window)
            rows, size = [], 0
    if rows:
        yield Items(rows, window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (`doc_id` among them), n_words, `hits` (merged word spans, end exclusive) and `items` (ids as strings, sorted as such).

    A window is `window` consecutive words of an item, or the whole item if it has fewer. A null or
    empty text has no words, hits or items; items of no words and items without an id take no part; an
    id that repeats counts once. Rows that repeat give results that repeat; other columns are ignored. To
    carry columns of any name, keep `row`, a struct of the whole row, from which the text is taken.
    """
    spark = docs.sparkSession
    schema = _schema(docs.select(*keep), "n_words long, hits array<struct<start: long, end: long>>, items array<string>")
    within = "row" in keep
    read = docs.select(*keep) if within else with_text(docs, *keep)
    texts = lambda b: texts_of(b["row"]) if within else b["_text"]
    parts = []
    for block in _blocks(items, window, block_bytes):
        all_of = spark.sparkContext.broadcast(block)

        def seen(b: dict, x=all_of) -> dict:
            counts: dict[tuple[int, int], int] = defaultdict(int)
            for t in b["_text"]:
                for key in x.value.held(x.value.read(t.as_py())):
                    counts[key] += 1
            return {"k": [k for k, _ in counts], "s": [s for _, s in counts], "n": list(counts.values())}

        counts = map_batches(with_text(docs.select(F.col("row.text").alias("text")) if within else docs), seen, "k int, s long, n long").groupBy("k", "s").agg(F.sum("n").alias("n"))
        block.index({(r["k"], r["s"]): r["n"] for r in counts.collect()})  # as many rows as the block has shingles
        all_of.destroy()
        index = spark.sparkContext.broadcast(block)

        def join(b: dict, x=index) -> dict:
            out: dict[str, list] = {"n_words": [], "hits": [], "items": []}
            for t in texts(b):
                w = x.value.read(t.as_py())
                spans, names = x.value.found(w)
                out["n_words"].append(len(w))
                out["hits"].append([{"start": s, "end": e} for s, e in _merged(spans)])
                out["items"].append(sorted(names))
            return {c: b[c] for c in keep} | out

        parts.append((join, index))
    if not parts:
        empty = Items([], window)
        empty.index({})
        nothing = lambda b: {c: b[c] for c in keep} | {"n_words": [len(words_of(t.as_py())) for t in texts(b)], "hits": [[] for _ in b[keep[0]]], "items": [[] for _ in b[keep[0]]]}
        return map_batches(read, nothing, schema)
    if len(parts) == 1:
        return map_batches(read, parts[0][0], schema)
    #: Several blocks: what each finds in a document meets again by the document's id and text.
    keyed = [map_batches(read, _with_digest(f, texts), _schema(schema, "_digest string")) for f, _ in parts]
    every = reduce(DataFrame.unionByName, [k.where(F.size("hits") > 0) for k in keyed]).groupBy("doc_id", "_digest").agg(F.flatten(F.collect_set("hits")).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    first = keyed[0].drop("hits", "items").alias("a")
    every = every.alias("b")
    met = first.join(every, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._digest") == F.col("b._digest")), "left").select(*(f"a.{c}" for c in keep), "n_words", "_hits", "_items")

    def merge(b: dict) -> dict:
        hits = [[{"start": s, "end": e} for s, e in _merged(sorted((h["start"], h["end"]) for h in x or []))] for x in b["_hits"].to_pylist()]
        return {c: b[c] for c in keep} | {"n_words": b["n_words"], "hits": hits, "items": [x or [] for x in b["_items"].to_pylist()]}

    return map_batches(met, merge, schema)


def _schema(own: DataFrame | StructType, more: str) -> StructType:
    fields = own.fields if isinstance(own, StructType) else own.schema.fields
    return StructType([*fields, *StructType.fromDDL(more).fields])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _with_digest(f, texts):
    return lambda b: f(b) | {"_digest": [hashlib.sha256(t.as_py()).hexdigest() for t in texts(b)]}


def report(found: DataFrame) -> DataFrame:
    n_hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]), F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
