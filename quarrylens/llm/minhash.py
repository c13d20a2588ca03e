"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts makes, per document, the set of its word shingles, ``bands * rows`` minima,
   the bands' keys, and a packed signature of the low ``b`` bits of all minima.  Documents with equal
   sets collapse to one node.
2. Documents that share a band key are candidates.  Each bucket's members are compared with its leader (the
   smallest node) by b-bit signatures: bit counts, corrected for chance agreement.  Members whose estimate falls
   short of the leader's are compared with all members of the bucket, in blocks.  Only a spanning forest of the
   pairs that pass leaves a task, never all pairs of a group.
3. The components of what passed are blocks: every link lies inside one, and documents that share
   phrases but are not alike do not chain into it.
4. Inside blocks the pairs that pass the signatures are confirmed on full sets.  Blocks above ``part_size`` nodes
   are dealt to parts, each with the block's hub (the node in most pairs) beside it.  What is linked to the hub needs
   no further test among itself; the rest is tested, in blocks, against every part, so no link is lost whatever the size.
5. The components of all links give every document its class: the smallest ``doc_id`` in it.

With 26 bands of 5 rows a pair of similarity 0.85 shares no band with probability 2.4e-7.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; with
fewer words than a shingle the whole sequence is the only element; rows with a null ``doc_id`` take no part
and come back with a null class and kept; repeated rows get the same class, and an id with several texts is linked by
each; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, scratch_path, split_join, staged, temporary
from .components import components

BANDS, ROWS, B = 26, 5, 4
WIDTH = 5
THRESHOLD = (85, 100)  # 100 * intersection >= 85 * union
PART_SIZE = 256

_SEGMENT = 1 << 18  # bytes of text hashed at once; a worker keeps 16 times as much in tables of powers
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (an array's products wrap around silently)."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 4096)
        inverse = pow(int(_BASE), -1, 1 << 64)
        tables = []
        for base in (_BASE, _U(inverse)):
            own = np.full(size, base, _U)
            own[0] = 1
            tables.append(np.multiply.accumulate(own))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _segment_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a piece of text."""
    a = np.frombuffer(raw, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, _U), starts
    power, inverse = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * power[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def word_hashes(texts: list[str | None], fold: bool = True) -> list[np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space) of each text; ``fold`` lower-cases A-Z."""
    out: list[np.ndarray] = []
    pending: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            hashes, starts = _segment_hashes(b" ".join(pending))
            at = np.cumsum([0] + [len(p) + 1 for p in pending])
            cuts = np.searchsorted(starts, at)
            out.extend(hashes[cuts[i] : cuts[i + 1]] for i in range(len(pending)))
            pending.clear()
            size = 0

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        raw = raw.lower() if fold else raw
        if len(raw) > _SEGMENT:
            flush()
            parts, at = [], 0
            while at < len(raw):
                end = at + _SEGMENT
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
                parts.append(_segment_hashes(raw[at:end])[0])
                at = end
            out.append(np.concatenate(parts))
            continue
        if size + len(raw) > _SEGMENT:
            flush()
        pending.append(raw)
        size += len(raw) + 1
    flush()
    return out


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | _U(1)


_STEP = _multipliers(64, 11)


def shingles_of(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles of one document's word hashes."""
    n = len(words)
    if not n:
        return np.empty(0, _U)
    k = min(width, n)
    total = np.zeros(n - k + 1, _U)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _STEP[i]
    return np.unique(mix(total + _U(k)))


def signatures(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """Minima (sets by hashes, unsigned 32-bit); all bits set for an empty set."""
    out = np.full((len(sets), n_hashes), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = (np.concatenate([sets[i] for i in full]) >> _U(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        low = _multipliers(2 * n_hashes, 23)
        for h in range(n_hashes):
            v = x * np.uint32(low[2 * h] & _U(0xFFFFFFFF))
            v ^= v >> np.uint32(16)
            v *= np.uint32(int(low[2 * h + 1] & _U(0xFFFFFFFF)) | 1)
            out[full, h] = np.minimum.reduceat(v, starts)
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    out = np.empty((len(minima), bands), np.int64)
    for band in range(bands):
        total = np.full(len(minima), band + 1, _U) * _STEP[63]
        for r in range(rows):
            total = mix(total + minima[:, band * rows + r].astype(_U)) * _STEP[r]
        out[:, band] = total.view(np.int64)
    return out


def pack_bits(minima: np.ndarray, b: int) -> np.ndarray:
    """The low ``b`` bits of all minima as ``b`` bit planes, (sets, b, bytes)."""
    planes = [np.packbits((minima >> np.uint32(i)).astype(np.uint8) & 1, axis=1) for i in range(b)]
    return np.stack(planes, 1)


def estimate(one: np.ndarray, others: np.ndarray, n_hashes: int, b: int) -> np.ndarray:
    """Similarity of a packed signature to others: agreeing positions by bit counts, less what chance gives."""
    return estimate_rows(one[None], others, n_hashes, b)


def estimate_rows(one: np.ndarray, others: np.ndarray, n_hashes: int, b: int) -> np.ndarray:
    """The same for signatures row by row."""
    differ = np.bitwise_or.reduce(others ^ one, axis=1)
    agree = 1 - np.bitwise_count(differ).sum(1, dtype=np.int64) / n_hashes
    chance = 0.5**b
    return (agree - chance) / (1 - chance)


def screen_bound(threshold: float, n_hashes: int, b: int, deviations: float = 5.0) -> float:
    """Below this estimate a pair reaches the threshold with negligible probability (5 deviations: 3e-7)."""
    chance = 0.5**b
    p = threshold + (1 - threshold) * chance
    return threshold - deviations * (p * (1 - p) / n_hashes) ** 0.5 / (1 - chance)


def _sketch(docs: DataFrame, bands: int, rows: int, b: int, width: int) -> DataFrame:
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                sets = [shingles_of(w, width) for w in word_hashes(batch.column(1).to_pylist())]
                n = [len(s) for s in sets]
                minima = signatures(sets, bands * rows)
                keys, planes = band_keys(minima, bands, rows), pack_bits(minima, b)
                node = np.array([int(mix(np.atleast_1d(np.bitwise_xor.reduce(mix(s))) + s.sum(dtype=_U) + _U(len(s))).view(np.int64)[0]) if len(s) else 0 for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node), pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel())), pa.array([p.tobytes() for p in planes], pa.binary())],
                    names=["id", "text_hash", "n", "node", "keys", "sig"],
                )

    return map_batches(docs, run, f"id {id_type}, text_hash bigint, n bigint, node bigint, keys array<bigint>, sig binary")


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, block, part columns ...) keep; the text becomes the binary of its sorted shingles."""
    keep = [c for c in docs.columns if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                sets = [shingles_of(w, width).tobytes() for w in word_hashes(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(sets, pa.binary())], names=[*keep, "shingles"])

    return map_batches(docs, run, ", ".join(f"{c} {types[c]}" for c in keep) + ", shingles binary")


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes (left by right) through products of incidence matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    rows = np.unique(np.concatenate([left, right]))
    place = {int(r): i for i, r in enumerate(rows)}
    values, counts = np.unique(np.concatenate([sets[r] for r in rows]), return_counts=True)
    values = values[counts > 1]
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    every = np.concatenate([sets[r] for r in rows])
    column = np.searchsorted(values, every)
    column[column == len(values)] = 0
    held = values[column] == every if len(values) else np.zeros(len(every), bool)
    owner, column = owner[held], column[held]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    l_at, r_at = np.array([place[int(r)] for r in left]), np.array([place[int(r)] for r in right])
    step = max(256, (1 << 22) // max(1, len(rows)))
    for first in range(0, len(values), step):
        a, b = np.searchsorted(column, [first, first + step])
        x = np.zeros((len(rows), min(step, len(values) - first)), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        out += x[l_at] @ x[r_at].T
    return out.astype(np.int64)


def link_block(sets: list[np.ndarray], planes: np.ndarray, n_hashes: int, b: int, threshold: tuple[int, int], roots: list[int] | None = None, left: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets that one task holds.

    ``roots``: classes already known to be connected (equal values), whose members need no test among
    themselves.  ``left``: only pairs with a member in it are tested (default: all).
    """
    num, den = threshold
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    bound = screen_bound(num / den, n_hashes, b)
    forest = _Forest(n)
    if roots is not None:
        first: dict[int, int] = {}
        for i, r in enumerate(roots):
            forest.tie(i, first.setdefault(r, i))
    only = None if left is None else set(left)
    found: list[tuple[float, int, int]] = []
    for i in range(n - 1) if only is None else sorted(only):
        start = i + 1 if only is None else 0
        fits = den * np.minimum(size[start:], size[i]) >= num * np.maximum(size[start:], size[i])
        js = np.flatnonzero(fits) + start
        if only is not None:
            js = js[js != i]
        if len(js):
            e = estimate(planes[i], planes[js], n_hashes, b)
            good = e >= bound
            found += [(-float(v), i, int(j)) for v, j in zip(e[good], js[good], strict=True)]
    edges: list[tuple[int, int]] = []

    def linked(i: int, j: int, common: int) -> bool:
        return den * common >= num * int(size[i] + size[j] - common)

    found.sort()
    if len(found) > 8 * n:  # many pairs: all intersections at once, block by block
        involved = np.unique([x for _, i, j in found for x in (i, j)])
        at = np.full(n, -1)
        at[involved] = np.arange(len(involved))
        for first in range(0, len(involved), 1024):
            rows = involved[first : first + 1024]
            common = _intersections(sets, rows, involved)
            inside = set(rows.tolist())
            for _, i, j in found:
                if i in inside and linked(i, j, common[at[i] - first, at[j]]) and forest.tie(i, j):
                    edges.append((i, j))
        return edges
    for _, i, j in found:
        if forest.root(i) != forest.root(j) and linked(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True))) and forest.tie(i, j):
            edges.append((i, j))
    return edges


def screened(buckets: DataFrame, n_hashes: int, b: int, bound: float, part_size: int) -> DataFrame:
    """(node, other): a spanning forest, bucket by bucket, of the pairs whose estimate reaches ``bound``.

    ``buckets``: (key, node, leader, mates, sig, near); ``near`` says whether the node passed with its bucket's leader.
    Only nodes that did not are compared here, with all members of the bucket but the leader, in cells of ``part_size`` squared.
    """
    rests = buckets.where("NOT near AND mates > 2").groupBy("key").agg(F.count(F.lit(1)).alias("r"))
    rows = split_join(buckets.where("node <> leader AND mates > 2"), rests, "key")
    parts, rest_parts = F.ceil(F.col("mates") / part_size).cast("int"), F.ceil(F.col("r") / part_size).cast("int")
    small = F.col("mates") <= part_size
    n_groups = max(64, (rests.agg(F.sum("r")).first()[0] or 0) // part_size)
    rows = rows.withColumn("k1", F.when(small, F.pmod(F.xxhash64("key"), F.lit(n_groups))).otherwise(F.col("key"))).select("*", parts.alias("parts"), rest_parts.alias("rest_parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tested = (
        rows.where("NOT near")
        .withColumn("k2", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest_parts")).cast("int"))
        .withColumn("k3", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("tested", F.lit(True))
    )
    every = rows.withColumn("k3", own).withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1))).withColumn("tested", F.lit(False))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, bucket in group.groupby("key", sort=False):
            bucket = bucket.sort_values(["tested", "node"], ascending=[False, True], kind="stable").drop_duplicates("node")
            nodes, near = bucket["node"].tolist(), bucket["near"].to_numpy()
            planes = np.stack([np.frombuffer(v, np.uint8).reshape(b, -1) for v in bucket["sig"]])
            forest, first = _Forest(len(nodes)), -1
            for i in np.flatnonzero(near).tolist():  # tied by their leader
                first = i if first < 0 else first
                forest.tie(first, i)
            for i in range(int(bucket["tested"].sum())):
                for j in np.flatnonzero(estimate(planes[i], planes, n_hashes, b) >= bound).tolist():
                    if j != i and forest.tie(i, j):
                        out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["node", "other"])

    columns = ["k1", "k2", "k3", "key", "node", "near", "sig", "tested"]
    cells = tested.select(*columns).unionByName(every.select(*columns)).repartition("k1", "k2", "k3")
    return cells.groupBy("k1", "k2", "k3").applyInPandas(compare, "node bigint, other bigint")


def _passes(pairs: DataFrame, n_hashes: int, b: int, bound: float) -> DataFrame:
    """(node, leader, near) of (node, leader, sig, leader_sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.stack([np.frombuffer(v, np.uint8) for v in batch.column(i).to_pylist()]).reshape(batch.num_rows, b, -1) for i in (2, 3))
            near = estimate_rows(one, two, n_hashes, b) >= bound
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["node", "leader", "near"])

    return map_batches(pairs, run, "node bigint, leader bigint, near boolean")


def _nodes(group: pd.DataFrame, b: int) -> tuple[list[np.ndarray], np.ndarray]:
    sets = [np.frombuffer(s, _U) for s in group["shingles"]]
    planes = np.stack([np.frombuffer(s, np.uint8).reshape(b, -1) for s in group["sig"]])
    return sets, planes


def near_duplicates(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, b: int = B, width: int = WIDTH,
    threshold: tuple[int, int] = THRESHOLD, part_size: int = PART_SIZE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = staged(_sketch(plain, bands, rows, b, width), "sketch")

    usable = sketch.where("n > 0 AND id IS NOT NULL")
    # one node for each distinct set; one of its documents, by id and hash of its text, gives the text again
    source = F.min(F.struct("id", "text_hash"))
    nodes = staged(usable.groupBy("node").agg(source["id"].alias("id"), source["text_hash"].alias("text_hash"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("n").alias("n")), "nodes")
    path = scratch_path(spark, "classes")
    with temporary(spark):
        _classes(plain, nodes, bands * rows, b, width, threshold, part_size).write.parquet(path)
    classes = spark.read.schema("node bigint, component bigint").parquet(path)

    named = usable.select("id", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    owned = nodes.select("node").join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    of_node = split_join(owned, least, "component").select("node", "component_id")  # a class may hold a third of all nodes
    found = sketch.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("node")).alias("node")).join(of_node, "node", "left")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def _classes(plain: DataFrame, nodes: DataFrame, n_hashes: int, b: int, width: int, threshold: tuple[int, int], part_size: int) -> DataFrame:
    """(node, component) of every node with a confirmed link."""
    banded = nodes.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("mates"), F.min("node").alias("leader")).where("mates > 1")
    stars = staged(split_join(banded, buckets, "key"), "stars")

    # every member of a bucket with its leader, each such pair once, then what is left among themselves
    signed = nodes.select("node", "sig")
    bound = screen_bound(threshold[0] / threshold[1], n_hashes, b)
    pairs = stars.where("node <> leader").select("node", "leader").distinct()
    pairs = pairs.join(signed, "node").join(signed.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig")), "leader").select("node", "leader", "sig", "leader_sig")
    led = staged(_passes(pairs, n_hashes, b, bound), "led")
    marked = stars.where("node <> leader AND mates > 2").join(led, ["node", "leader"]).join(signed, "node")
    alike = led.where("near").select("node", F.col("leader").alias("other")).unionByName(screened(marked, n_hashes, b, bound, part_size))
    alike = staged(alike.distinct(), "alike")
    blocks = components(alike, "blocks")
    weight = alike.select("node").unionAll(alike.select("other")).groupBy("node").agg(F.count(F.lit(1)).alias("weight"))

    # block sizes and hubs, then the parts of large blocks
    member = staged(
        blocks.withColumnRenamed("component", "block").join(weight, "node").join(nodes.select("node", "id", "text_hash", "sig"), "node"), "members"
    )
    sizes = member.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.max_by("node", F.struct("weight", F.negative("node"))).alias("hub"))
    placed = split_join(member, sizes, "block").withColumn("parts", F.ceil(F.col("m") / part_size).cast("int"))
    placed = placed.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(F.lit(0)))
    # a document id may stand for several texts: the hash picks the one that makes the node's set
    texts = plain.where(F.col("id").isNotNull()).join(placed.select("node", "id", "text_hash", "sig", "block", "hub", "parts", "part"), ["id", "text_hash"])
    # repeated rows of that text are combined before anything is grouped
    with_sets = _with_sets(texts.drop("id", "text_hash"), width).dropDuplicates(["block", "node"])
    sets = staged(with_sets, "sets")

    # small blocks are dealt out together, large ones part by part, each part with the hub
    is_hub = F.col("node") == F.col("hub")
    n_groups = max(64, member.count() // part_size)
    small = sets.where("parts = 1").withColumn("k1", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("long")).withColumn("k2", F.lit(-1))
    large = sets.where("parts > 1")
    own = large.where(~is_hub).withColumn("k1", F.col("block")).withColumn("k2", F.col("part"))
    hubs = large.where(is_hub).withColumn("k1", F.col("block")).withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = small.unionByName(own).unionByName(hubs)

    def diagonal(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in group.groupby("block", sort=False):
            block = block.sort_values("node", kind="stable").reset_index(drop=True)
            ids = block["node"].tolist()
            forest = _Forest(len(ids))
            for i, j in link_block(*_nodes(block, b), n_hashes, b, threshold):
                forest.tie(i, j)
            hub = ids.index(block["hub"][0]) if block["hub"][0] in ids else -1
            at_hub = forest.root(hub) if hub >= 0 else -1
            for i, node in enumerate(ids):
                root = ids[hub] if forest.root(i) == at_hub else ids[forest.root(i)]
                out.append((node, root, bool(forest.root(i) == at_hub)))
        return pd.DataFrame(out, columns=["node", "root", "with_hub"])

    local = staged(first.groupBy("k1", "k2").applyInPandas(diagonal, "node bigint, root bigint, with_hub boolean"), "local").distinct()
    edges = local.where("node <> root").select("node", "root")

    # the rest of large blocks against all parts
    state = local.groupBy("node").agg(F.min("root").alias("root"), F.max("with_hub").alias("with_hub"))
    known = large.join(state, "node")
    rest_sizes = known.where("NOT with_hub").groupBy("block").agg(F.count(F.lit(1)).alias("r"))
    known = split_join(known, rest_sizes, "block").withColumn("rests", F.ceil(F.col("r") / part_size).cast("int"))
    rest = (
        known.where("NOT with_hub")
        .withColumn("k2", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")).cast("int"))
        .withColumn("k3", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("tested", F.lit(True))
    )
    every = known.withColumn("k3", F.col("part")).withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("tested", F.lit(False))

    def across(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tested", "node"], ascending=[False, True], kind="stable").drop_duplicates("node").reset_index(drop=True)
        ids = group["node"].tolist()
        left = np.flatnonzero(group["tested"]).tolist()
        found = link_block(*_nodes(group, b), n_hashes, b, threshold, group["root"].tolist(), left)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["node", "root"])

    # the rows come partitioned by block, which would keep all cells of a large one in a single task
    crossing = rest.unionByName(every).repartition("block", "k2", "k3").groupBy("block", "k2", "k3").applyInPandas(across, "node bigint, root bigint")
    return components(edges.unionByName(crossing), "classes")
