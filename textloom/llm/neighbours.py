"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of about SHARD by a hash of their id. A shard's graph starts at random; each
vector is sought in it greedily, and what the search visits proposes its neighbours. The proposals are
pruned with relaxed distances: the nearest one stays and drops those that are ALPHA times nearer to it
than to the vector, and so on, so the edges that stay point in different directions. A query searches
every shard's graph with a beam; the shards' answers meet in a window over the query.

Equal vectors are one node: a node carries the smallest ids of its vectors, as many as an answer can
need, so that no group of copies, however large, fills a beam or a neighbourhood.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, EXPAND = 4096, 32, 64, 96, 1.2, 4
STARTS, BATCH = 12, 256
#: Queries of a block; a block of queries and a shard meet in one task.
BLOCK = 4096


def search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, visited: bool = False):
    """Beam search of all queries in step: ids and similarities of the beam, best first; also what was visited."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    ids = np.full((b, beam), n)
    near = np.full((b, beam), -np.inf, np.float32)
    k = min(beam, len(starts))
    ids[:, :k] = starts[:k]
    near[:, :k] = q @ x[starts[:k]].T
    seen[:, starts[:k]] = True
    open_ = np.zeros((b, beam), bool)
    open_[:, :k] = True
    trail = [ids[:, :k].copy()] if visited else None
    live = np.arange(b)
    while len(live):
        rank = np.where(open_[live], near[live], -np.inf)
        pick = np.argpartition(-rank, min(EXPAND, beam) - 1, 1)[:, :EXPAND]
        rows = np.arange(len(live))[:, None]
        some = rank[rows, pick] > -np.inf
        nodes = np.where(some, ids[live[:, None], pick], n)
        open_[live[:, None], pick] = False
        new = graph[nodes].reshape(len(live), -1)
        new = np.where(seen[live[:, None], new], n, new)
        new.sort(1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        seen[live[:, None], new] = True
        sim = np.einsum("bkd,bd->bk", x[np.minimum(new, n - 1)], q[live], dtype=np.float32)
        sim[new == n] = -np.inf
        if visited:
            full = np.full((b, new.shape[1]), n)
            full[live] = new
            trail.append(full)
        all_ids, all_sim = np.concatenate([ids[live], new], 1), np.concatenate([near[live], sim], 1)
        all_open = np.concatenate([open_[live], new < n], 1)
        top = np.argpartition(-all_sim, beam - 1, 1)[:, :beam]
        ids[live], near[live], open_[live] = all_ids[rows, top], all_sim[rows, top], all_open[rows, top] & (all_sim[rows, top] > -np.inf)
        live = live[open_[live].any(1)]
    order = np.argsort(-near, 1, kind="stable")
    out = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    return (*out, np.concatenate(trail, 1)) if visited else out


def prune(x: np.ndarray, p: int, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    c = np.unique(candidates)
    c = c[(c < len(x)) & (c != p)]
    far = np.maximum(2 - 2 * (x[c] @ x[p]), 0)
    order = np.argsort(far, kind="stable")[: 4 * degree]
    c, far = c[order], far[order]
    between = np.maximum(2 - 2 * (x[c] @ x[c].T), 0)
    alive, kept = np.ones(len(c), bool), []
    while len(kept) < degree and alive.any():
        k = int(alive.argmax())
        kept.append(k)
        alive &= alpha * alpha * between[k] > far  # squared distances
        alive[k] = False
    return c[kept]


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The graph (n + 1, degree), filled up with n, and the starts; x holds unit vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    graph = np.full((n + 1, degree), n)
    if n <= degree + 1:
        for p in range(n):
            graph[p, : n - 1] = np.delete(np.arange(n), p)
        return graph, np.arange(min(n, STARTS))
    graph[:n, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    middle = int((x @ x.mean(0)).argmax())
    starts = np.unique(np.r_[middle, rng.permutation(n)[: STARTS - 1]])
    order = rng.permutation(n)
    for at in range(0, n, BATCH):
        some = order[at : at + BATCH]
        _, _, seen = search(x, graph, x[some], starts, beam, True)
        back: dict[int, list[int]] = {}
        for p, trail in zip(some.tolist(), seen, strict=True):
            kept = prune(x, p, np.r_[trail, graph[p]])
            graph[p] = n
            graph[p, : len(kept)] = kept
            for k in kept.tolist():
                back.setdefault(k, []).append(p)
        for k, new in back.items():
            old = graph[k][graph[k] < n]
            both = np.unique(np.r_[old, new])
            if len(both) > degree:
                both = prune(x, k, both)
            graph[k] = n
            graph[k, : len(both)] = both
    return graph, starts


def _unit(v: np.ndarray) -> np.ndarray:
    """Scaled first, so that neither tiny nor huge numbers are lost in the squares."""
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a with rows of b, in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every` the k nearest others by cosine.

    A null id, and a vector that is null, empty or zero or holds null or non-finite numbers, takes no
    part. Vectors meet those of their own length. Rows that repeat id and vector count once; ties go to
    the smaller id; with fewer than k others all are returned. Other columns are ignored.
    """
    spark = vectors.sparkSession
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", number) & F.exists("v", lambda v: v != 0))
    rows = cut(rows.distinct(), "vectors")
    # a window limit, which Spark applies before the shuffle too: k + 1 ids of equal vectors, the query's own among them
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    nodes = cut(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors-nodes")
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by([("first", "ascending")])
        graph, starts = build(_unit(_matrix(t["v"])))
        return t.drop_columns(["first"]).append_column("edges", pa.array(list(graph[:-1].astype(np.int32)), pa.list_(pa.int32()))).append_column("place", pa.array(np.arange(len(t)), pa.int32())).append_column("start", pa.array(np.isin(np.arange(len(t)), starts)))

    kinds = "shard int, dim int, v array<double>, ids array<long>"
    graphs = cut(dealt.select("shard", "dim", "v", "ids", F.get("ids", 0).alias("first")).groupBy("shard", "dim").applyInArrow(make, kinds + ", edges array<int>, place int, start boolean"), "graphs")
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def find(q: pa.Table, g: pa.Table) -> pa.Table:
        if not len(q) or not len(g):
            return out.empty_table()
        g = g.sort_by([("place", "ascending")])
        x = _matrix(g["v"])
        n = len(x)
        graph = np.full((n + 1, DEGREE), n)
        edges = g["edges"].combine_chunks()
        graph[:n] = edges.flatten().to_numpy().reshape(n, -1)
        starts = np.flatnonzero(g["start"].to_numpy())
        unit, v = _unit(x), _matrix(q["v"])
        asked, ids = q["query_id"].to_pylist(), g["ids"].to_pylist()
        res: dict[str, list] = {"query_id": [], "ids": [], "score": []}
        for at in range(0, len(v), BATCH):
            found, _ = search(unit, graph, _unit(v[at : at + BATCH]), starts, min(beam, n))
            found = found[:, : 4 * (k + 1)]  # exact scores decide among these
            for j in range(len(found)):
                f = found[j][found[j] < n]
                s = cosines(np.repeat(v[at + j : at + j + 1], len(f), 0), x[f])
                order = sorted(range(len(f)), key=lambda i: (-s[i], ids[f[i]][0]))[: k + 1]
                res["query_id"] += [asked[at + j]] * len(order)
                res["ids"] += [ids[f[i]] for i in order]
                res["score"] += [float(s[i]) for i in order]
        return pa.Table.from_pydict(res, out)

    keys = ["shard", "dim", "block"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(find, "query_id long, ids array<long>, score double")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
