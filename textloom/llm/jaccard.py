"""An exact join of documents by the Jaccard similarity of their shingle sets, as a metric-space join.

The number of shingles in which two sets differ is a metric, and so is the Hamming distance of their
parity sketches (the parity of each hash bucket's shingles), which is never larger. Regions are made and
joined in four steps, all of them lossless:

1. By size. Size pivots cut sets into intervals by their distance to the empty set; a set whose partners
   may lie in the next interval is replicated there.
2. By trace. Two linked sets of sizes up to y differ in at most D = y * 2 (1 - t) / (1 + t) shingles. The
   shingles are dealt to D + 1 facets; in one of them the traces of both sets are equal, at distance 0.
   A trace is the pivot of the region of all sets that have it. A few more facets make up for empty
   ones; sets with more empty facets than that are dealt anew with other facets, recursively.
3. By hub. In a region the set that meets most others is the first pivot. All others are compared with it.
   Regions in which that leaves one component are done.
4. By Voronoi cells. In an open region each set goes to the cell of its nearest pivot and, by the triangle
   inequality, to every cell whose pivot is at most 2 D farther; cells split again by pivots of their own
   until they are small or no longer shrink. In a cell, sets of different components whose sketches allow
   a link are proposed, nearest first; proposals are verified on the whole sets, components grow, and what
   failed isn't proposed again. First a cell proposes one pair for each two components, then each set
   many times as many each round. It ends when no cell proposes anything.

Pivots without the first two steps don't work here: sets of different texts are all at a distance near 1
from any document, so every document lies in every window (README has figures).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, discard, map_batches, release, released, table, texts_of
from .components import components
from .shingles import mix, shingle_sets

BAND_RATIO, DEPTH = 1.5, 6
#: Members of a region that one task joins, of a cell that isn't split further, and pivots of a split.
REGION, LEAF, PIVOTS = 4096, 64, 8
#: By how much the pairs that a set proposes grow each round.
GROWTH = 16
#: A split whose largest cell keeps more than this share of the members doesn't pay.
SHRINK = 0.7
#: Bits of a parity sketch: the power of two that is at least eight times the allowed difference, within these.
SKETCH = (64, 1 << 16)
#: Bytes of sketches, and rows of 100 bytes besides, that a task of the region join gets.
TASK_BYTES, ROW_BYTES = 16_000_000, 100
#: Bits of the filter of documents whose sets are needed again; its size doesn't grow with the data.
FILTER_BITS = 1 << 24
#: Sets that a task remembers to have dealt, so that copies of one text are dealt once.
REMEMBERED = 500_000
#: Numbers of sets that no id names lie from here up, after the ids of most tables.
UNNAMED = 1 << 62


@dataclass(frozen=True)
class Threshold:
    """Linked: of * intersection >= at * union."""

    at: int = 90
    of: int = 100

    def differ(self, larger: int) -> int:
        return (self.of - self.at) * 2 * larger // (self.of + self.at)

    def near(self, differ, n, m):
        """Whether sets of sizes n and m that differ in `differ` shingles are linked."""
        return differ * (self.of + self.at) <= (n + m) * (self.of - self.at)

    def partner(self, n: int) -> int:
        return n * self.of // self.at


def bands(upto: int) -> list[int]:
    """Starts of the size intervals."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND_RATIO))))
    return out


@cache
def facets(t: Threshold, start: int, end: int) -> tuple[int, int]:
    """How many facets sets of the size interval [start, end) are dealt to, and how many may be empty.

    Of D + 1 + c facets, at least one more than c holds no difference; if c is at least the number of a
    set's empty facets, one that isn't empty is among them. c is a little over what chance leaves empty.
    """
    differ, least = t.differ(end - 1), max(1, start * t.at // t.of)
    k, c = differ + 1, 0
    for _ in range(50):
        mean = k * np.exp(-least / k) if k > 1 else 0.0
        c = int(mean + 3 * np.sqrt(mean))
        if differ + 1 + c == k:
            break
        k = differ + 1 + c
    return k, k - differ - 1


def _traces(x: np.ndarray, k: int, empty: int, band: int) -> list[np.ndarray]:
    """Keys of the traces of a set in k facets. With more empty facets than allowed for, the set is dealt
    once more with other facets, as is any set like it; at the last level empty traces are keys too."""
    out = []
    for level in range(DEPTH):
        seed = 100 + 10 * level
        with np.errstate(over="ignore"):
            facet = ((mix(x, seed) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            order = np.argsort(facet, kind="stable")
            held, first = np.unique(facet[order], return_index=True)
            sums = np.add.reduceat(mix(x, seed + 1)[order], first)
            where = mix(np.array([band], np.uint64), seed + 2)[0]
            out.append(mix(sums ^ (mix(held, seed + 3) + where), seed))
            if k - len(held) <= empty:
                break
            if level == DEPTH - 1:
                out.append(mix(np.setdiff1d(np.arange(k, dtype=np.uint64), held), seed + 5) + where)
    return out


def keys(x: np.ndarray, t: Threshold, edges: np.ndarray) -> np.ndarray:
    """Regions of a set: of its own size interval and of the next if a larger partner may be there."""
    n = len(x)
    home = int(np.searchsorted(edges, n, "right")) - 1
    last = int(np.searchsorted(edges, t.partner(n), "right")) - 1
    return np.concatenate([y for b in range(home, last + 1) for y in _traces(x, *facets(t, int(edges[b]), int(edges[b + 1])), b)])


def _signature(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(x, 7).sum(dtype=np.uint64).astype(np.int64)), int(mix(x, 8).sum(dtype=np.uint64).astype(np.int64))


def sketch(x: np.ndarray, t: Threshold) -> bytes:
    """The parity of the number of shingles in each bucket. Folded in halves by XOR it is the shorter sketch."""
    bits = SKETCH[0]
    while bits < min(SKETCH[1], 8 * t.differ(len(x))):
        bits *= 2
    odd = np.bincount((mix(x, 9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """A row of 64-bit words for each sketch, all as short as the shortest."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    by: dict[int, list[int]] = {}
    for k, s in enumerate(sketches):
        by.setdefault(len(s), []).append(k)
    for size, at in by.items():
        v = np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), size // 8)
        while v.shape[1] > width:
            v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
        out[at] = v
    return out


def _steps(b: pa.RecordBatch, bytes_: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    at, texts, size = 0, [], 0
    for k, t in enumerate(b.column("_text") if "_text" in b.schema.names else texts_of(b.column("r"))):
        texts.append(t.as_py())
        size += len(texts[-1])
        if size > bytes_:
            yield at, texts
            at, texts, size = k + 1, [], 0
    if texts:
        yield at, texts


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("_text"))


def signed_rows(rows: DataFrame, words: int, t: Threshold | None = None) -> DataFrame:
    """The rows (the text is `_text`, which goes, or in the whole row r) and n, s1, s2: the size of its set and the set's fingerprint of 128 bits.

    With a threshold also sk, the set's sketch.
    """
    columns = [c for c in rows.columns if c != "_text"]

    def run(batches):
        for b in batches:
            for at, texts in _steps(b):
                sets = list(shingle_sets(texts, words))
                s = [_signature(x) for x in sets]
                more = [pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in s], pa.int64()), pa.array([x[1] for x in s], pa.int64())]
                more += [pa.array([sketch(x, t) for x in sets], pa.binary())] if t else []
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(texts)) for c in columns), *more], [*columns, "n", "s1", "s2", *["sk"][: bool(t)]])

    schema = rows.select(columns).schema
    for name in ("n", "s1", "s2"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(released(run), schema.add("sk", "binary") if t else schema)


def regions(docs: DataFrame, words: int, t: Threshold, largest: int) -> DataFrame:
    """key, s1 and others of every region that a document's set is dealt to.

    others: the sets of the same step of reading that are dealt to it too, so that of a region which a
    large part of all documents is dealt to, few rows are shuffled.
    """
    edges = np.array(bands(t.partner(largest) + 1) + [2**62])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, texts in _steps(b):
                out, who = [], []
                for x in shingle_sets(texts, words):
                    if len(x) and (s := _signature(x)[0]) not in seen:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(s)
                        k = keys(x, t, edges)
                        out.append(k)
                        who.append(np.full(len(k), s, np.int64))
                if out:
                    key, s1 = np.concatenate(out).view(np.int64), np.concatenate(who)
                    order = np.argsort(key, kind="stable")
                    key, s1 = key[order], s1[order]
                    first = np.r_[True, key[1:] != key[:-1]]
                    start, upto = np.flatnonzero(first), np.cumsum(~first)
                    ends = np.r_[0, upto[np.r_[start[1:], len(key)] - 1]].astype(np.int32)
                    alone = pa.array(np.diff(ends) == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(s1[start]), pa.ListArray.from_arrays(pa.array(ends), pa.array(s1[~first]), mask=alone)], ["key", "s1", "others"])

    return _read(docs).select("_text").mapInArrow(released(run), "key long, s1 long, others array<long>")


def _places(column="id"):
    return [F.pmod(F.xxhash64(F.lit(k), column), F.lit(FILTER_BITS)).cast("int") for k in (1, 2)]


def _bits(places: DataFrame) -> np.ndarray:
    """The bit filter of the places p."""
    packed = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p % 32)")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    out[packed["w"].to_numpy(int)] = packed["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, prints: DataFrame, words: int) -> DataFrame:
    """s1, s2 and set of the documents named in ids whose s1 is in prints (and by chance of a few others).

    Documents are read again and their sets made anew, so nothing of them is shuffled; bit filters of a
    fixed size, sent to all tasks, tell which documents are meant. A task gives a set once.
    """
    context = docs.sparkSession.sparkContext
    by_id = context.broadcast(_bits(ids.select(F.explode(F.array(*_places())).alias("p"))))
    by_print = context.broadcast(_bits(prints.select(F.pmod("s1", F.lit(FILTER_BITS)).cast("int").alias("p"))))

    def run(batches):
        bits, wanted = by_id.value, by_print.value
        hit = lambda p: bits[p >> 5] >> (p & 31).astype(np.uint32) & 1
        seen: set[tuple[int, int]] = set()
        for b in batches:
            p, q = (b.column(c).to_numpy(zero_copy_only=False) for c in ("p", "q"))
            b = b.filter(pa.array((hit(p) & hit(q)).astype(bool)))
            for _, texts in _steps(b):
                sets, s = [], []
                for x in shingle_sets(texts, words):
                    y = _signature(x)
                    place = y[0] % FILTER_BITS
                    if y not in seen and int(wanted[place >> 5]) >> (place & 31) & 1:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(y)
                        sets.append(x)
                        s.append(y)
                if sets:
                    values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in s], pa.int64()), pa.array([x[1] for x in s], pa.int64()), values], ["s1", "s2", "set"])

    return _read(docs).select("_text", *(c.alias(n) for c, n in zip(_places(), "pq", strict=True))).mapInArrow(released(run), "s1 long, s2 long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """a, b, inter, uni of every pair of set numbers; exact."""
    one = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return one.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), inter.alias("inter")).select("a", "b", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni"))


def linked(docs: DataFrame, words: int, t: Threshold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the different sets (c, n, s1, s2, own, first, last, lead, sk), and node and component of sets that are linked.

    Sets are the vertices. An id that rows of different sets share names none of them, nor does a null id
    of rows of different sets. own is the smallest id that names the set, or null; c is own, or else a
    number of UNNAMED or more made from the set's print. first, last: the ids of its rows; lead: the
    smallest that isn't null.
    """
    signed = cut(signed_rows(_read(docs), words, t), "jaccard-signatures")
    null = F.col("id") == NULL_ID
    of_null = lambda f, c: f(F.when(null, F.col(c)))
    largest, lo, hi, least = signed.agg(F.max("n"), of_null(F.min, "s1"), of_null(F.max, "s1"), of_null(F.min, "n")).first()
    nulls = lo is not None and (lo != hi or least == 0)
    several = cut(signed.where(~null).groupBy("id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("id"), "jaccard-shared-ids")
    shared = several.unionByName(docs.sparkSession.range(1).select(F.lit(NULL_ID).alias("id"))) if nulls else several
    full = signed.where("n > 0")
    own = full.withColumn("own", F.when(~null, F.col("id")) if nulls else F.col("id"))
    if not several.isEmpty():  # null ids, which may be a large part of the rows, don't meet in the join
        told = own.where(~null).join(several.select("id", F.lit(True).alias("_shared")), "id", "left")
        own = own.where(null).unionByName(told.withColumn("own", F.when(F.col("_shared").isNull(), F.col("id"))).drop("_shared"))
    grouped = own.groupBy("n", "s1", "s2").agg(F.min("own").alias("own"), F.min("id").alias("first"), F.max("id").alias("last"), F.coalesce(F.min(F.when(F.col("id") != NULL_ID, F.col("id"))), F.lit(NULL_ID)).alias("lead"), F.min("sk").alias("sk"))
    unnamed = F.col("s1").bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    classes = cut(grouped.withColumn("c", F.coalesce("own", unnamed)), "jaccard-classes")
    found = docs.sparkSession.createDataFrame([], "node long, component long")
    if largest:
        members = _members(regions(docs, words, t, largest), classes)
        found = _connected(docs, words, members, classes, shared, t)
        discard(members)
    return signed, classes, found


def join(docs: DataFrame, words: int = 5, t: Threshold = Threshold(80, 100)) -> DataFrame:
    """id (NULL_ID for null), n_shingles and component (the smallest id reachable by links) of every row.

    A null text, an empty one and one without words have an empty set, link with nothing and have their
    own id as component. Rows of equal sets are linked. Sharing an id doesn't link: an id (null too) that
    rows of different sets have names no component, and a component of such rows only has a number made
    from the print of one of its sets, of UNNAMED or more. Very long texts are read in steps. An empty
    table gives an empty result; other columns are ignored.
    """
    signed, classes, found = linked(docs, words, t)
    part = F.coalesce("component", "c")
    to = classes.join(found, classes["c"] == found["node"], "left").where("first <> last OR c <> last OR component IS NOT NULL").select("n", "s1", "s2", part.alias("component"))
    return signed.drop("sk").join(to, ["n", "s1", "s2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, t: Threshold = Threshold(80, 100)) -> DataFrame:
    """The rows of docs, but of each component of links (see join) only one, with all columns as they were.

    It is a row of the component's set of the smallest number (the smallest id that names one of its
    sets), and of that set's rows the one of the smallest doc_id, nulls last; of several of those the one
    of the smallest text, then of the smallest row as JSON. Rows of empty sets (null and empty texts, no
    words) are in no component and all stay. Columns of any name and type are carried along.
    """
    signed, classes, found = linked(docs, words, t)
    lost = found.where("node <> component").select(F.col("node").alias("c"))
    kept = classes.join(lost, "c", "left_anti").select("n", "s1", "s2", "lead")
    repeated = cut(signed.where("n > 0").groupBy("n", "s1", "s2", F.col("id").alias("lead")).count().where("count > 1").select("n", "s1", "s2", "lead"), "jaccard-repeated")
    rows = docs.select(F.struct("*").alias("r"))
    again = signed_rows(rows, words).withColumn("id", F.coalesce("r.doc_id", F.lit(NULL_ID))).withColumn("s2", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("s2")))
    stay = again.join(kept, ["n", "s1", "s2"], "left").where("n = 0 OR id = lead")
    if repeated.isEmpty():
        return stay.select("r.*")
    of = ["n", "s1", "s2", "lead"]
    order = F.struct("r.text", F.to_json("r").alias("j"))
    first = stay.join(repeated, of, "left_semi").groupBy("n", "s1", "s2").agg(F.min_by("r", order).alias("r"))
    return stay.join(repeated, of, "left_anti").select("r.*").unionByName(first.select("r.*"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _members(dealt: DataFrame, classes: DataFrame) -> DataFrame:
    """key, m, c, n of the regions that hold several sets, m of them; of regions with the same members one stays."""
    w = Window.partitionBy("key")
    met = dealt.withColumn("lo", F.min("s1").over(w)).withColumn("hi", F.max("s1").over(w)).withColumn("more", F.max(F.col("others").isNotNull()).over(w)).where("lo <> hi OR more")
    met = cut(met.select("key", F.explode(F.concat(F.array("s1"), F.coalesce("others", F.array().cast("array<long>")))).alias("s1")).distinct(), "jaccard-regions")
    alike = met.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("s1")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "s1")).alias("y"))
    one = alike.groupBy("m", "x", "y").agg(F.min("key").alias("key")).where("m > 1").select("key", "m")
    return cut(met.join(one, "key").join(classes.select("s1", "n", "c"), "s1").select("key", "m", "c", "n"), "jaccard-members", met)


def _possible(pairs: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sk").alias(f"sk{x}"))

    def run(of):
        n, m = (of[c].to_numpy() for c in ("na", "nb"))
        differ = np.array([np.bitwise_count(np.bitwise_xor(*_folded([x, y]))).sum() for x, y in zip(of["ska"].to_pylist(), of["skb"].to_pylist(), strict=True)])
        near = pa.array(t.near(differ, n, m))
        return {c: of[c].filter(near) for c in ("a", "b")}

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long")


class _Links:
    """Verified links, their components, and the sets that were read for them."""

    def __init__(self, docs: DataFrame, words: int, classes: DataFrame, shared: DataFrame, t: Threshold):
        self.docs, self.words, self.classes, self.shared, self.t = docs, words, classes, shared, t
        spark = docs.sparkSession
        self.sets: list[DataFrame] = []
        self.done = spark.createDataFrame([], "a long, b long")
        self.parts = spark.createDataFrame([], "node long, component long")

    def add(self, pairs: DataFrame) -> None:
        """Verifies pairs (a, b) of set numbers that weren't verified before."""
        pairs = cut(pairs.join(self.done, ["a", "b"], "left_anti"), "jaccard-pairs")
        if pairs.isEmpty():
            return
        needed = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        for have in self.sets:
            needed = needed.join(have.select("c"), "c", "left_anti")
        needed = cut(needed.join(self.classes.select("c", "s1", "s2"), "c"), "jaccard-needed")
        if not needed.isEmpty():
            again = sets_of(self.docs, needed.select(F.col("c").alias("id")).unionByName(self.shared), needed, self.words)
            self.sets.append(cut(needed.join(again, ["s1", "s2"]).dropDuplicates(["c"]).select("c", "set"), "jaccard-sets", needed))
        seen = cut(verified(pairs, _union(self.sets), self.t), "jaccard-verified", pairs)
        links = seen.where(F.col("inter") * self.t.of >= F.col("uni") * self.t.at).select("a", "b")
        self.done = cut(self.done.unionByName(seen.select("a", "b")), "jaccard-done", self.done)
        before = self.parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        old, self.parts = self.parts, components(before.unionByName(links))
        discard(seen, old)


def _connected(docs: DataFrame, words: int, members: DataFrame, classes: DataFrame, shared: DataFrame, t: Threshold) -> DataFrame:
    """node and component of the sets that are linked with another one."""
    links = _Links(docs, words, classes, shared, t)
    degrees = members.groupBy("c").agg(F.sum("m").alias("degree"))
    ranked = cut(members.join(degrees, "c"), "jaccard-ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("c").alias("x"), F.col("c").alias("hub"), F.col("n").alias("hn"))).alias("h")).select("key", "h.hub", "h.hn")
    met = ranked.join(hubs, "key").where("c <> hub")
    in_size = F.least("n", "hn") * t.of >= F.greatest("n", "hn") * t.at
    links.add(_possible(met.where(in_size).select(F.greatest("c", "hub").alias("a"), F.least("c", "hub").alias("b")).distinct(), classes, t))
    state = _opened(met.where("m > 2").select("key", "c", "hub", F.lit(False).alias("tile")), links.parts)
    state = cut(state.join(classes.select("c", "n", "sk"), "c"), "jaccard-open", ranked)
    state = _split(state, t)
    state = cut(_dealt(state), "jaccard-dealt", state)
    tried = docs.sparkSession.createDataFrame([], "bucket long, a long, b long")
    budget = 0
    while not state.isEmpty():
        found = cut(_proposals(state, tried, t, budget), "jaccard-proposals")
        if found.isEmpty():
            break
        links.add(found.where("b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        still = found.where("b IS NULL").select("key")  # in the other regions no possible partner is left
        state = cut(_opened(state.drop("component"), links.parts, still), "jaccard-open", state)
        tried = cut(tried.unionByName(found.where("b IS NOT NULL").select("bucket", "a", "b")), "jaccard-tried", tried, found)
        budget = max(GROWTH, budget * GROWTH)
    discard(state, tried, *links.sets, links.done)
    return links.parts


def _opened(state: DataFrame, parts: DataFrame, still: DataFrame | None = None) -> DataFrame:
    """The rows of regions (of those in `still`, if given) whose sets are of several components, with their component."""
    now = state.join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    several = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return now.join(several.join(still, "key") if still else several, "key", "left_semi")


def _dealt(state: DataFrame) -> DataFrame:
    """Adds bucket, the task that joins a region: regions of one hub share tasks, as they hold the same sets
    over and over; a hub whose regions are more than a task's share is dealt to several by region."""
    size = F.sum(F.octet_length("sk") + ROW_BYTES)
    deal = max(1, (state.agg(size).first()[0] or 0) // TASK_BYTES)
    tasks = state.groupBy("hub").agg(F.ceil(size / TASK_BYTES).alias("tasks"))
    own = F.pmod(F.xxhash64(F.lit(6), "key"), F.col("tasks"))
    return state.join(tasks, "hub").withColumn("bucket", F.pmod(F.xxhash64("hub", own), F.lit(deal)).cast("long")).select("bucket", "key", "c", "n", "sk", "component")


def _split(state: DataFrame, t: Threshold) -> DataFrame:
    """Splits regions of over REGION sets into Voronoi cells, again and again; a region whose cells don't
    shrink, as all its sets lie in one window, is compared tile by tile, each with each."""
    columns = state.columns
    while True:
        large = cut(state.where("NOT tile").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > REGION), "jaccard-large")
        if large.isEmpty():
            discard(large)
            return state
        rows = state.where("NOT tile").join(large, "key")
        pivots = [F.min(F.struct(F.xxhash64(F.lit(k), "c").alias("x"), F.col("sk"))).alias(f"p{k}") for k in range(PIVOTS)]
        pivots = rows.groupBy("key").agg(*pivots, F.max("n").alias("most"), F.min(F.octet_length("sk")).alias("width"))
        wide = rows.join(pivots.select("key", "most", "width", F.array(*(f"p{k}.sk" for k in range(PIVOTS))).alias("pivots")), "key")
        cells = cut(map_batches(wide, lambda of: _cells(of, t), "key long, cell int, m long, c long, hub long, tile boolean, component long, n long, sk binary"), "jaccard-cells")
        sizes = cells.groupBy("key", "cell").agg(F.count("*").alias("k"), F.max("m").alias("m"))
        pays = cut(sizes.groupBy("key").agg((F.max("k") <= F.max("m") * SHRINK).alias("pays")), "jaccard-pays")
        cell = cells.join(pays.where("pays"), "key").withColumn("key", F.xxhash64("key", F.lit(0), "cell"))
        tiles = F.ceil(F.col("m") * 2 / REGION)
        tile = rows.join(pays.where("NOT pays"), "key").withColumn("own", F.pmod(F.xxhash64(F.lit(99), "c"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        tile = tile.withColumn("key", F.xxhash64("key", F.lit(1), F.least("own", "other"), F.greatest("own", "other"))).withColumn("tile", F.lit(True))
        rest = state.join(large, "key", "left_anti")
        state = cut(_union([x.select(columns) for x in (rest, cell, tile)]), "jaccard-open", state, cells, large, pays)


def _runs(key: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each different key."""
    order = np.argsort(key, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else ()


def _cells(of: dict, t: Threshold) -> dict:
    """Each row in the cell of its nearest pivot and in those whose pivot is at most 2 D farther."""
    row, cell = [], []
    sk, width = of["sk"].to_pylist(), of["width"].to_numpy()
    for at in _runs(of["key"].to_numpy()):
        short = b"\0" * int(width[at[0]])
        pivots = list(dict.fromkeys(of["pivots"][int(at[0])].as_py()))
        v = _folded([*(sk[k] for k in at), *pivots, short])
        near = _within(v[: len(at)], v[len(at) : -1], t.differ(of["most"][int(at[0])].as_py()))
        i, j = np.nonzero(near)
        row.append(at[i])
        cell.append(j)
    take = pa.array(np.concatenate(row))
    return {c: of[c].take(take) for c in ("key", "m", "c", "hub", "tile", "component", "n", "sk")} | {"cell": pa.array(np.concatenate(cell).astype(np.int32))}


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None]).sum(-1, dtype=np.int64)


def _within(x: np.ndarray, pivots: np.ndarray, differ: int) -> np.ndarray:
    """Which cells each sketch lies in or may have a partner in, by the triangle inequality."""
    d = _distances(x, pivots)
    return d <= d.min(1, keepdims=True) + 2 * differ


class _Task:
    """What the regions that one task joins share: the pairs tried before and proposed now, and components as if those were linked."""

    def __init__(self, t: Threshold, budget: int, tried: list[tuple[int, int]]):
        self.t, self.budget = t, budget
        self.tried: dict[int, set[int]] = {}
        self.proposed: dict[int, set[int]] = {}
        self.pairs: list[tuple[int, int]] = []
        self.root: dict[int, int] = {}
        for a, b in tried:
            self._add(self.tried, a, b)

    def _add(self, to: dict[int, set[int]], a: int, b: int) -> None:
        to.setdefault(a, set()).add(b)
        to.setdefault(b, set()).add(a)

    def find(self, x: int) -> int:
        while (y := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(y, y)
        return x

    def propose(self, a: int, b: int, part_a: int, part_b: int) -> None:
        self._add(self.proposed, a, b)
        self.pairs.append((a, b))
        if not self.budget:
            self.root[self.find(part_a)] = self.find(part_b)


class _Region:
    """Proposes pairs of one region's sets that connect whatever its sketches allow to be connected."""

    def __init__(self, c: np.ndarray, n: np.ndarray, sketches: list[bytes], component: np.ndarray, task: _Task):
        self.c, self.n, self.v, self.component, self.task = c, n, _folded(sketches), component, task
        self.t, self.budget = task.t, task.budget
        different, self.first = np.unique(component, return_inverse=True)
        self.part = np.array([task.find(x) for x in different.tolist()])[self.first]
        self.open = False

    def join(self, at: np.ndarray) -> None:
        """Splits the sets `at` into Voronoi cells as long as that pays, then compares."""
        if (self.first[at] == self.first[at[0]]).all():
            return
        if len(at) > LEAF:
            pivots = at[np.linspace(0, len(at) - 1, PIVOTS).astype(int)]
            near = _within(self.v[at], self.v[pivots], self.t.differ(int(self.n[at].max())))
            if near.sum(0).max() <= SHRINK * len(at):
                for k in range(PIVOTS):
                    if near[:, k].any():
                        self.join(at[near[:, k]])
                return
        step = max(1, 1_000_000 // (len(at) * self.v.shape[1]))
        for k in range(0, len(at) - 1, step):
            self._compare(at[k : k + step], at[k:])

    def _compare(self, rows: np.ndarray, at: np.ndarray) -> None:
        n, m = self.n[rows][:, None], self.n[at][None]
        may = (self.first[rows][:, None] != self.first[at][None]) & (np.minimum(n, m) * self.t.of >= np.maximum(n, m) * self.t.at)
        if not may.any():
            return
        d = _distances(self.v[rows], self.v[at])
        may &= self.t.near(d, n, m)
        for k in np.flatnonzero(may.any(1)).tolist():
            i, others = int(rows[k]), np.flatnonzero(may[k])
            others = self._without(self.task.tried, i, at, others[others > k])
            self.open |= len(others) > 0
            others = self._without(self.task.proposed, i, at, others)
            others = others[self.part[at[others]] != self.part[i]]
            if not len(others):
                continue
            others = others[np.argsort(d[k, others], kind="stable")]
            if self.budget:
                others = others[: self.budget]
            else:  # the nearest of each component, which counts as linked from now on
                part, first = np.unique(self.part[at[others]], return_index=True)
                others = others[first]
                self.part[np.isin(self.part, part)] = self.part[i]
            for j in at[others].tolist():
                self.task.propose(int(self.c[i]), int(self.c[j]), int(self.component[i]), int(self.component[j]))

    def _without(self, known: dict[int, set[int]], i: int, at: np.ndarray, others: np.ndarray) -> np.ndarray:
        own = known.get(int(self.c[i]))
        return others[~np.isin(self.c[at[others]], np.fromiter(own, np.int64, len(own)))] if own else others


def _proposals(state: DataFrame, tried: DataFrame, t: Threshold, budget: int) -> DataFrame:
    """bucket, key, a, b of the pairs that each task proposes: for each set at most `budget` in each region that aren't in `tried`.

    With a budget of 0, for each set the nearest of every other component; in the task they count as
    linked from then on, so that few are proposed. Rows without a and b name the regions that hold a pair
    of different components that isn't in `tried`, proposed or not.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = state.select("bucket", "key", "c", "n", "sk", "component", none("long", "other"))
    rows = rows.unionByName(tried.select("bucket", none("long", "key"), F.col("a").alias("c"), none("long", "n"), none("binary", "sk"), none("long", "component"), F.col("b").alias("other")))

    def run(table: pa.Table) -> pa.Table:
        bucket, c = table["bucket"][0].as_py(), table["c"].to_numpy()
        told = table["other"].is_valid().to_numpy()
        key, n, component, other = (table[x].fill_null(0).to_numpy() for x in ("key", "n", "component", "other"))
        sk = table["sk"].to_pylist()
        task = _Task(t, budget, list(zip(c[told].tolist(), other[told].tolist(), strict=True)))
        mine, open_ = np.flatnonzero(~told), []
        for at in _runs(key[mine]):
            own = mine[at]
            own = own[np.argsort(c[own])]
            region = _Region(c[own], n[own], [sk[k] for k in own], component[own], task)
            region.join(np.arange(len(own)))
            open_ += [int(key[own[0]])] * region.open
        k, m = len(task.pairs), len(open_)
        a, b = ([x[j] for x in task.pairs] + [None] * m for j in range(2))
        return pa.table([pa.array(x, pa.int64()) for x in ([bucket] * (k + m), [None] * k + open_, a, b)], ["bucket", "key", "a", "b"])

    def run_released(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return rows.groupBy("bucket").applyInArrow(run_released, "bucket long, key long, a long, b long")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents"), 3, Threshold(90, 100))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(back("id").alias("doc_id"), "n_shingles", back("component").alias("component_id"))
