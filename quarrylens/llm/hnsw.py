"""Approximate nearest neighbours: one navigable small-world graph per shard.

Distinct vectors are dealt to shards by hash.  Each shard builds a hierarchical navigable small-world
graph and stores it as flat arrays (one neighbour array for each layer, fixed width, -1 for none) in a row
of a table, so an index can be written once and searched often.  A shard is small enough to compare its vectors in
blocks of matrix products, so each node's candidates on a layer are its true nearest ones there; from them
neighbours are chosen by diversity, and links go both ways.

Queries are packed into blocks, and every block goes to every shard: queries move, not the index (which is copied only
once for each ``QUERY_BLOCK`` queries).  All queries of a block walk a shard's graph in step, one expansion each at a
time.  Shard results, at most k a query, are merged by exact distance.

Copies of one vector are one node that carries the smallest ids of its copies: more of them than a query
can return (k, and one for the query itself) can never show in a result.  Spark limits each group to that
many rows before and after the shuffle, so a vector that a third of all rows share costs no task more
than others.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither as candidates nor as queries, and rows with a null id neither; vectors of different length are
never compared; fewer candidates than k give all of them; ties in distance go to the smaller id; a repeated
id is a candidate for other ids as often as it has distinct vectors, and a query for each of them; repeated rows are
one query; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

M = 16
EF_BUILD = 64
EF_SEARCH = 96
SHARD_SIZE = 16384
QUERY_BLOCK = 4096
#: Queries that walk in step, rows that are compared in one product, and expansions of a query at a time.
STEP, ROWS, WIDE = 256, 512, 3
K = 10


def usable(vector: Column) -> Column:
    """Finite, without nulls, not empty and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """A navigable small-world graph over rows of a matrix, as flat arrays."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray], entry: int):
        self.x, self.layers, self.members, self.entry = x, layers, members, entry
        self.norm = np.einsum("ij,ij->i", x, x)

    def _near(self, q: np.ndarray, qn: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own rows (-1: infinite)."""
        near = self.norm[rows] - 2 * np.einsum("qcd,qd->qc", self.x[rows], q) + qn[:, None]
        return np.where(rows >= 0, near, np.inf)

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The ``ef`` nearest rows found for each query, -1 for none."""
        n_q, qn = len(q), np.einsum("ij,ij->i", q, q)
        best = np.full((n_q, 1), self.entry)
        every = np.arange(n_q)
        for layer in range(len(self.layers) - 1, 0, -1):
            near = self._near(q, qn, best)[:, 0]
            while True:  # step to the nearest neighbour as long as it is nearer
                rows = self.layers[layer][best[:, 0]]
                dist = self._near(q, qn, rows)
                at = dist.argmin(1)
                better = dist[every, at] < near
                if not better.any():
                    break
                best[better, 0] = rows[every, at][better]
                near = np.where(better, dist[every, at], near)
        links = self.layers[0]
        ef = min(ef, len(self.x))
        seen = np.zeros((n_q, len(self.x) + 1), bool)  # the last column takes the absent neighbours
        found, near, done = np.full((n_q, ef), -1), np.full((n_q, ef), np.inf), np.zeros((n_q, ef), bool)
        found[:, :1], near[:, :1] = best, self._near(q, qn, best)
        seen[every, best[:, 0]] = True
        active = every
        while len(active):
            # the nearest rows not yet expanded; a query is through when all of its ef best are
            open_ = np.where(done[active], np.inf, near[active])
            wide = min(WIDE, ef)
            at = np.argpartition(open_, wide - 1, axis=1)[:, :wide]
            take = np.take_along_axis(open_, at, 1) < np.inf
            going = take.any(1)
            active, at, take = active[going], at[going], take[going]
            if not len(active):
                break
            done[active[:, None], at] |= take
            rows = np.where(take[:, :, None], links[found[active[:, None], at]], -1).reshape(len(active), -1)
            rows.sort(1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
            rows[seen[active[:, None], rows]] = -1
            seen[active[:, None], rows] = True
            seen[:, -1] = False
            dist = self._near(q[active], qn[active], rows)
            pool, pool_near = np.concatenate([found[active], rows], 1), np.concatenate([near[active], dist], 1)
            pool_done = np.concatenate([done[active], np.zeros(rows.shape, bool)], 1)
            keep = np.argpartition(pool_near, ef - 1, axis=1)[:, :ef]
            found[active], near[active], done[active] = (np.take_along_axis(v, keep, 1) for v in (pool, pool_near, pool_done))
        return np.where(near < np.inf, found, -1)


def _candidates(x: np.ndarray, members: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member its ``ef`` nearest other members (all, if fewer), nearest first, as positions, and squared distances."""
    own = x[members]
    norm = np.einsum("ij,ij->i", own, own)
    n, k = len(members), min(ef, len(members) - 1)
    near, dist = np.empty((n, k), np.int64), np.empty((n, k))
    for at in range(0, n, ROWS):
        d = norm[at : at + ROWS, None] + norm[None] - 2 * (own[at : at + ROWS] @ own.T)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.lexsort((part, np.take_along_axis(d, part, 1)))
        near[at : at + ROWS] = np.take_along_axis(part, order, 1)
        dist[at : at + ROWS] = np.take_along_axis(d, near[at : at + ROWS], 1)
    return near, dist


def _diverse(x: np.ndarray, near: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """For each row up to ``m`` of its candidates (rows of ``x``, nearest first, -1: none): those nearer to it than to any chosen before, then the nearest left over."""
    out = np.full((len(near), m), -1, np.int64)
    for at in range(0, len(near), ROWS):
        c, d = near[at : at + ROWS], dist[at : at + ROWS]
        v = x[c]
        norm = np.einsum("qcd,qcd->qc", v, v)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        closest = np.full(c.shape, np.inf)  # to what is chosen so far
        rank = np.full(c.shape, 2, np.int64)  # 0 chosen, 1 left over, 2 none
        count = np.zeros(len(c), np.int64)
        for j in range(c.shape[1]):
            there = c[:, j] >= 0
            good = there & (d[:, j] < closest[:, j]) & (count < m)
            rank[:, j] = np.where(good, 0, np.where(there, 1, 2))
            count += good
            closest = np.where(good[:, None], np.minimum(closest, between[:, :, j]), closest)
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        picked = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(c, order, 1), -1)
        out[at : at + ROWS, : picked.shape[1]] = picked
    return out


def _links(x: np.ndarray, members: np.ndarray, m: int, ef: int, width: int) -> np.ndarray:
    """Neighbours of each member of a layer as rows of ``x``: ``m`` chosen by diversity, then those that chose it, cut to ``width`` by diversity."""
    n = len(members)
    if n < 2:
        return np.full((n, width), -1, np.int64)
    near, dist = _candidates(x, members, ef)
    chosen = _diverse(x[members], near, dist, m)
    a, j = np.nonzero(chosen >= 0)
    b = chosen[a, j]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))  # both ways
    a, b = pairs // n, pairs % n
    gap = x[members[a]] - x[members[b]]
    d = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    starts = np.searchsorted(a, np.arange(n + 1))
    count = np.diff(starts)
    out = np.full((n, width), -1, np.int64)
    place = np.arange(len(a)) - starts[a]
    few = count <= width
    ok = few[a]
    out[a[ok], place[ok]] = b[ok]
    many = np.flatnonzero(~few)
    # nodes that many chose, by size, so that a hub's long list pads no other
    for at in range(0, len(many), ROWS):
        some = many[np.argsort(count[many], kind="stable")][at : at + ROWS]
        longest = min(int(count[some].max()), 8 * width)  # beyond that only the farthest candidates fall away
        c, dd = np.full((len(some), longest), -1, np.int64), np.full((len(some), longest), np.inf)
        for i, r in enumerate(some.tolist()):
            own = slice(starts[r], min(starts[r + 1], starts[r] + longest))
            c[i, : own.stop - own.start], dd[i, : own.stop - own.start] = b[own], d[own]
        out[some] = _diverse(x[members], c, dd, width)
    return np.where(out >= 0, members[out], -1)


def build(x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 3) -> Graph:
    """The graph over all rows; a node's top layer falls geometrically."""
    n = len(x)
    rng = np.random.default_rng(seed)
    tops = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 8)
    layers, members = [], []
    for layer in range(int(tops.max()) + 1):
        own = np.flatnonzero(tops >= layer)
        width = 2 * m if layer == 0 else m
        full = np.full((n, width), -1, np.int32)
        full[own] = _links(x, own, m, ef, width)
        layers.append(full)
        members.append(own)
    return Graph(x, layers, members, int(np.argmax(tops)))


def exact_distances(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, the same for equal vectors whatever their place."""
    d = rows - q
    return np.sqrt(np.add.reduce(d * d, axis=1))


INDEX_SCHEMA = "shard int, dim int, n int, ids binary, first binary, copies binary, vectors binary, layers array<binary>, entry int"


def pack_graph(shard: int, ids: list[list[int]], x: np.ndarray, graph: Graph) -> dict:
    copies = np.array([len(i) for i in ids], np.int32)
    flat = np.array([v for i in ids for v in i], np.int64)
    layers = [np.concatenate([m.astype(np.int32)[:, None], graph.layers[i][m]], 1) for i, m in enumerate(graph.members)]
    return {
        "shard": shard, "dim": x.shape[1], "n": len(x), "ids": flat.tobytes(), "first": np.cumsum(np.append(0, copies))[:-1].astype(np.int64).tobytes(),
        "copies": copies.tobytes(), "vectors": x.tobytes(), "layers": [np.int32(a.shape[1]).tobytes() + a.tobytes() for a in layers], "entry": graph.entry,
    }


def unpack_graph(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
    layers, members = [], []
    for raw in row["layers"]:
        width = int(np.frombuffer(raw[:4], np.int32)[0])
        a = np.frombuffer(raw[4:], np.int32).reshape(-1, width)
        full = np.full((row["n"], width - 1), -1, np.int32)
        full[a[:, 0]] = a[:, 1:]
        layers.append(full)
        members.append(a[:, 0])
    return Graph(x, layers, members, row["entry"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64), np.frombuffer(row["copies"], np.int32)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(vector, ids): every distinct usable vector with its ``keep`` smallest ids, ascending."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    first = Window.partitionBy("vector").orderBy("id")
    return rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= keep).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index(vectors: DataFrame, n_shards: int, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """One row for each shard and vector length: the graph as flat arrays (``INDEX_SCHEMA``)."""
    rows = distinct_vectors(vectors, id_col, vector_col, k + 1)
    dealt = rows.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(n_shards)).cast("int"))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        ids = [sorted(map(int, i)) for i in group["ids"]]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], group["vector"].iloc[i].tolist()))
        x = np.stack([group["vector"].iloc[i] for i in order]).astype(np.float64)
        return pd.DataFrame([pack_graph(int(group["shard"].iloc[0]), [ids[i] for i in order], x, build(x, m, ef))])

    return dealt.groupBy("shard", "dim").applyInPandas(make, INDEX_SCHEMA)


def search_shard(row: dict, ids: np.ndarray, vectors: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, int, float]]:
    """(place among the queries, candidate id, distance) of the k nearest in one shard."""
    graph, own, first, copies = unpack_graph(row)
    for at in range(0, len(ids), STEP):
        found = graph.search(vectors[at : at + STEP], max(ef, k + 1))
        for i, rows in enumerate(found, at):
            rows = rows[rows >= 0]
            dist = exact_distances(vectors[i], graph.x[rows])
            out = []
            for d, r in sorted(zip(dist.tolist(), rows.tolist(), strict=True)):
                if len(out) >= k and d > out[-1][0]:
                    break
                out += [(d, v) for v in own[first[r] : first[r] + copies[r]].tolist() if v != ids[i]]
            for d, v in sorted(out)[:k]:
                yield i, v, d


def search(indexed: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH, block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, itself left out."""
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    q = q.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    q = q.dropDuplicates(["id", "vector"]).withColumn("dim", F.size("vector"))
    n_blocks = max(1, -(-q.count() // block))
    shards = indexed.select(F.max("shard").alias("top")).first()["top"]
    # every block meets every shard once: the stated queries against all rows, in blocks
    dealt = q.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks)).cast("int")).withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards or 0))))
    left = dealt.repartition("q_shard", "dim", "block")
    right = indexed.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition("shard", "dim", "r_block")
    # a query is its id and its whole vector
    out = "query_id bigint, query binary, vec_id bigint, score double"

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, vectors = a["id"].to_numpy(), np.stack(a["vector"].to_numpy()).astype(np.float64)
        found = list(search_shard(b.iloc[0].to_dict(), ids, vectors, k, ef))
        at, near, dist = (np.array([f[i] for f in found], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        keys = [blake2b(v.tobytes(), digest_size=32).digest() for v in vectors]
        return pd.DataFrame({"query_id": ids[at], "query": [keys[i] for i in at], "vec_id": near, "score": dist})

    near = left.groupBy("q_shard", "dim", "block").cogroup(right.groupBy("shard", "dim", "r_block")).applyInPandas(run, out)
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int, k: int = K, shard_size: int = SHARD_SIZE, ef: int = EF_SEARCH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index every row and search the rows whose id is divisible by ``every``."""
    n = vectors.count()
    indexed = staged(index(vectors, max(1, -(-n // shard_size)), k, id_col, vector_col), "hnsw")
    return search(indexed, vectors.where(F.col(id_col) % every == 0), k, ef, id_col=id_col, vector_col=vector_col)


def recall(found: DataFrame, vectors: pd.DataFrame, k: int = K) -> float:
    """Share of the true k nearest that were found, by distance; ``vectors``: all rows on one machine, for tests and tuning."""
    x = np.stack(vectors["embedding"].to_numpy()).astype(np.float64)
    ids = vectors["vec_id"].to_numpy()
    place = {int(v): i for i, v in enumerate(ids)}
    hits = total = 0
    for qid, own in found.toPandas().groupby("query_id"):
        d = exact_distances(x[place[int(qid)]], x)
        d[place[int(qid)]] = np.inf
        limit = np.sort(d)[: min(k, len(ids) - 1)][-1]
        hits += int((own["score"] <= limit + 1e-12).sum())
        total += min(k, len(ids) - 1)
    return hits / max(1, total)
