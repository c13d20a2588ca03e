"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A document is its token ids and one end id.  It is cut into pieces whose lengths fit the slots of
reciprocal-capacity classes: class ``k`` has slots of ``capacity // k`` tokens and its bins hold
exactly ``k`` pieces.  A rest that fills at least ``fill`` of the tightest slot becomes one piece of
that class; otherwise the next smaller slot is cut off it in full and the rest goes on, so every full
bin is filled to ``fill`` at least and nothing depends on any other document.

Bins are numbered without coordination: each worker ranks its own pieces by class while it tokenizes,
an exclusive scan over the small table of (worker, class) counts turns ranks into global ones, and
``rank // k`` is the bin.  Only the last bin of each class can be short; the pieces of those bins (fewer
than the sum of all ``k``, whatever the input) are packed again by first fit.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by one; a null
``doc_id`` is carried as null; an empty table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import map_batches, staged

CAPACITY = 1024
FILL = 0.97
#: Pieces per bin of each class; 16 classes exactly or nearly divide the capacity.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 341, 512, 1024)
_BIN_BITS = 44  # a sequence id is its class above this bit and its bin below; repacked bins are class 0

#: Scripts in which all versions of Unicode agree on what is a letter, a number or white space.
_PLAIN = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
_state: dict[str, tuple] = {}


def _encoders(path: str) -> tuple:
    """Of one tokenizer file, in this worker: the tokenizer, the same vocabulary as ranks (or None), and a search for its special strings."""
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        _state[path] = (tokenizer, _ranked(spec, set(special)), re.compile("|".join(map(re.escape, special)) or "(?!)").search)
    return _state[path]


def _ranked(spec: dict, special: set[str]):
    """An encoder over ranks for a plain byte-level BPE whose ids follow the order of its merges; else None."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or sorted(made) != made or len(set(made)) != len(made):
        return None
    import tiktoken

    byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
    ranks = {b"".join(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Texts of Latin script without special strings go through the vocabulary's ranks, which is twice as
    fast and gives the same ids; all others go through the tokenizer itself.
    """
    tokenizer, ranked, special = _encoders(path)
    out = []
    for text in texts:
        if not text:
            out.append(b"")
        elif ranked is not None and _PLAIN(text) and not special(text):
            out.append(array("I", ranked.encode_ordinary(text)).tobytes())
        else:
            out.append(array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
    return out


def cutter(capacity: int, fill: float, classes: tuple[int, ...]) -> Callable[[int], list[tuple[int, int]]]:
    """A function from a document's length to its pieces (length, class), memoised by the rest below the capacity."""
    slots = [(capacity // k, k) for k in sorted(classes)]
    known: dict[int, list[tuple[int, int]]] = {0: []}

    def rest(r: int) -> list[tuple[int, int]]:
        if r not in known:
            out, left = [], r
            while left:
                at = max(i for i, (slot, _) in enumerate(slots) if slot >= left)
                slot, k = slots[at]
                if left >= fill * slot or at + 1 == len(slots):
                    out.append((left, k))
                    break
                slot, k = slots[at + 1]
                out.append((slot, k))
                left -= slot
            known[r] = out
        return known[r]

    return lambda n: [(capacity, 1)] * (n // capacity) + rest(n % capacity)


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, fill: float = FILL, classes: tuple[int, ...] = CLASSES,
    end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = False,
) -> DataFrame:
    """Cut every document: (id_col, start, length, ids_crc32, doc_tokens, k, part, rank[, ids]).

    ``part`` is the worker's partition and ``rank`` the number of earlier pieces of class ``k`` in it.
    """
    if not {1, capacity} <= set(classes):
        raise ValueError("classes must hold 1 and the capacity, so that every rest can be cut")
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = frame.schema["id"].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "k", "part", "rank"] + ["ids"] * keep_ids
    schema = f"`{id_col}` {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, k int, part int, rank bigint" + ", ids binary" * keep_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, ranks, part = cutter(capacity, fill, classes), dict.fromkeys(classes, 0), TaskContext.get().partitionId()
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            ids_in = batch.column(0)
            rows: list[tuple] = []
            owners: list[int] = []
            for i, ids in enumerate(encode_texts(batch.column(1).to_pylist(), tokenizer_path)):
                ids += end
                n, start = len(ids) // 4, 0
                for length, k in cut(n):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((start, length, zlib.crc32(own), n, k, part, ranks[k], own))
                    owners.append(i)
                    ranks[k] += 1
                    start += length
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            arrays = [ids_in.take(pa.array(owners, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    return map_batches(frame, run, schema)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given."""
    room: list[int] = []
    out = []
    for n in lengths:
        at = next((i for i, left in enumerate(room) if left >= n), len(room))
        if at == len(room):
            room.append(capacity)
        out.append((at, capacity - room[at]))
        room[at] -= n
    return out


def assign(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Give every piece of ``pieces()`` its sequence and offset.  ``cut`` is read more than once: stage it first."""
    counts = cut.groupBy("part", "k").agg(F.count(F.lit(1)).alias("n"))
    scan = Window.partitionBy("k").orderBy("part")
    starts = counts.withColumn("before", F.sum("n").over(scan) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    ranked = (
        cut.join(starts.drop("n"), ["part", "k"])
        .withColumn("at", F.col("before") + F.col("rank"))
        .withColumn("bin", F.floor(F.col("at") / F.col("k")).cast("long"))
        .withColumn("short", F.col("bin") * F.col("k") + F.col("k") > F.col("total"))
        .drop("part", "rank", "before", "total")
    )
    sequence = F.shiftleft(F.col("k").cast("long"), _BIN_BITS) + F.col("bin")
    alone = ranked.where("k = 1").withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", sequence)
    inside = Window.partitionBy("k", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        ranked.where("k > 1 AND NOT short")
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
        .withColumn("sequence_id", sequence)
    )
    rest = ranked.where("k > 1 AND short").withColumn("offset", F.lit(None).cast("long")).withColumn("sequence_id", F.lit(None).cast("long"))
    schema = rest.schema

    def repack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "k", "at"], ascending=[False, True, True], kind="stable")
        placed = first_fit(group["length"].tolist(), capacity)
        return group.assign(sequence_id=[b for b, _ in placed], offset=[o for _, o in placed])

    rest = rest.groupBy(F.lit("rest").alias("all")).applyInPandas(repack, schema)
    return alone.unionByName(shared).unionByName(rest).drop("k", "at", "bin", "short")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, fill: float = FILL, classes: tuple[int, ...] = CLASSES, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset; with ``keep_ids`` also each piece's ids (little-endian unsigned 32-bit)."""
    cut = pieces(docs, tokenizer_path, capacity, fill, classes, keep_ids=keep_ids, id_col=id_col, text_col=text_col)
    return assign(staged(cut, "pieces"), capacity, id_col)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """One row per sequence of ``pack(keep_ids=True)``: the ids as one binary, padded to the capacity unless its length is a power of two."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = (F.octet_length("ids") / 4).cast("int")
    pad = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(capacity) - n)
    blank = F.lit(int(pad_id).to_bytes(4, "little") * capacity)
    return (
        packed.groupBy("sequence_id")
        .agg(joined.alias("ids"))
        .withColumn("n_tokens", n)
        .withColumn("ids", F.concat(F.col("ids"), F.substring(blank, F.lit(1), pad * 4)))
    )
