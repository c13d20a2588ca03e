"""Sparse random indexing of tokens, weighted sums, and quantisation to signed bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import dealt, tasks

DIM = 1024
NONZERO = 8
#: FNV-1a of 64 bits and the step between seeds (fixed values: stored vectors depend on them).
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
SEED_STEP = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def fnv1a(raw: bytes, start: int = FNV_OFFSET) -> int:
    for b in raw:
        start = (start ^ b) * FNV_PRIME & _WRAP
    return start


def random_index(token: str, dim: int = DIM, nonzero: int = NONZERO) -> np.ndarray:
    """A sparse vector fixed by the token: each of a few seeded hashes gives a place and, by its top bit, a sign.

    The seeds depend on the whole token and its length; signs that meet in one place add up.
    """
    raw = token.encode("utf-8")
    root = fnv1a(raw) ^ (len(raw) * FNV_PRIME & _WRAP)
    hashes = [fnv1a(raw, root ^ (k * SEED_STEP & _WRAP)) for k in range(nonzero)]
    out = np.zeros(dim, np.float64)
    np.add.at(out, [h % dim for h in hashes], [1.0 - 2.0 * (h >> 63) for h in hashes])
    return out


def quantize(v: np.ndarray) -> np.ndarray:
    """Unit length, times 127, rounded and clamped to signed bytes; a zero vector stays zero."""
    norm = np.linalg.norm(v)
    return np.zeros(len(v), np.int8) if norm == 0 else np.clip(np.rint(v / norm * 127), -127, 127).astype(np.int8)


def token_vectors(tokens: DataFrame, token_col: str, dim: int = DIM) -> DataFrame:
    """(token, vector of bytes) for each distinct token."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"token": pdf["token"], "vector": [quantize(random_index(t, dim)).tolist() for t in pdf["token"]]})

    return tokens.select(F.col(token_col).alias("token")).where("token IS NOT NULL").distinct().mapInPandas(run, "token string, vector array<tinyint>")


def entity_vectors(tokens: DataFrame, entity: str, token: str, idf: DataFrame, dim: int = DIM) -> DataFrame:
    """(entity, vector): the idf-weighted sum of an entity's token vectors, quantised.

    Tokens meet their idf by join, a frequent one in sixteen parts; an entity's few weighted tokens are gathered and summed where they are.
    """
    rows = tokens.select(F.col(entity).alias("entity"), F.col(token).alias("token"))
    n, keys = tasks(rows), ["token", "__part"]
    left = dealt(rows.withColumn("__part", F.pmod(F.xxhash64("entity"), F.lit(16)).cast("int")), *keys, n=n)
    right = dealt(idf.select("token", "idf", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("__part")), *keys, n=n)
    weighted = dealt(left.join(right, keys), "entity", n=n).groupBy("entity", "token").agg((F.first("idf") * F.count(F.lit(1))).alias("w"))
    lists = weighted.groupBy("entity").agg(F.collect_list(F.struct("token", "w")).alias("parts"))
    kind = lists.schema["entity"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = []
            for parts in pdf["parts"]:
                out.append(quantize(sum((p["w"] * random_index(p["token"], dim) for p in sorted(parts, key=lambda p: p["token"])), np.zeros(dim))).tolist())
            yield pd.DataFrame({"entity": pdf["entity"], "vector": out})

    return lists.mapInPandas(run, f"entity {kind}, vector array<tinyint>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """The k nearest to one query vector by cosine, ties by id: a scan with a bounded heap in every task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    score = F.when(dot(v, v) > 0, dot(v, q) / F.sqrt(dot(v, v)) / F.sqrt(dot(q, q))).otherwise(0.0)
    return vectors.select(F.col(id_col).alias("id"), score.alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)
