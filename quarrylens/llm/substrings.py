"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends after a word whose last window hashes below a bound, so
cut points depend on nearby content alone and an insertion moves only the chunks it touches.  A chunk's
digest is taken over its words.  Every distinct digest belongs to the smallest ``doc_id`` that holds it;
later documents lose the runs of chunks they share if a run has ``min_words`` words or more.  Inside one
document the first occurrence stays.

Chunks end after one word in five, so a shared passage of 51 words loses about ten words at its two ends
to chunks that reach over them; a run of 20 words is enough to recognise it, and lines or phrases of fewer
words never form one.

The (digest, doc_id) pairs are written once to the shared folder.  They are combined before the shuffle to the least id
of each digest; what occurs in one document only falls away, and the rest is joined back as two plain shuffles, so that
Spark splits a chunk that very many documents hold.  What a document shares returns as one array for the document.

Defined cases: a null text stays null and an empty one empty; rows of one ``doc_id`` do not deduplicate each
other; rows with a null ``doc_id`` neither own chunks nor lose any to others (their own repeats go); an
empty table gives an empty result; all columns are carried under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, split_join, staged
from .minhash import _SEGMENT, _SPACE, _power_tables, mix

MIN_WORDS = 20
MEAN_WORDS = 5
MAX_WORDS = 64
_U = np.uint64
_WINDOW = 16
_GEAR = np.random.default_rng(41).integers(0, 1 << 32, 256, dtype=np.uint32)
_PAD = b" " * _WINDOW


def gear(a: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: the sum of the table's values of the last 16 bytes, each shifted by its distance."""
    h = _GEAR[a]
    for step in (1, 2, 4, 8):
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step)
        h = h + moved
    return h


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and gear hash at the last byte of every word."""
    a = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[a], [True]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, _U), starts, ends, np.empty(0, np.uint32)
    power, inverse = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * power[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts, ends, gear(a)[ends - 1]


def _chunk(hashes: np.ndarray, rolled: np.ndarray, mean_words: int, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every chunk (and the number of words at the end), and digests."""
    n = len(hashes)
    if not n:
        return np.zeros(1, np.int64), np.empty(0, np.int64)
    cuts = np.flatnonzero(rolled[:-1] < np.uint32((1 << 32) // mean_words)) + 1
    cuts = np.concatenate(([0], cuts, [n]))
    gaps = np.diff(cuts)
    if gaps.max() > max_words:
        cuts = np.concatenate([np.arange(a, b, max_words) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [[n]])
        gaps = np.diff(cuts)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(hashes * power[:n], out=total[1:])
    digests = mix((total[cuts[1:]] - total[cuts[:-1]]) * inverse[cuts[:-1]] + gaps.astype(_U))
    return cuts, digests.view(np.int64)


def chunk_texts(texts: list[str | None], mean_words: int = MEAN_WORDS, max_words: int = MAX_WORDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: first words of its chunks (with the number of words last), digests, and the byte at which each word starts."""
    out: list = []
    pending: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            hashes, starts, _, rolled = _words(_PAD + _PAD.join(pending))
            at = np.cumsum([_WINDOW] + [len(p) + _WINDOW for p in pending])
            cut = np.searchsorted(starts, at)
            for i in range(len(pending)):
                own = slice(cut[i], cut[i + 1])
                out.append((*_chunk(hashes[own], rolled[own], mean_words, max_words), starts[own] - at[i]))
            pending.clear()
            size = 0

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > _SEGMENT:
            flush()
            found, at = [], 0
            while at < len(raw):
                end = at + _SEGMENT
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
                lead = raw[max(0, at - _WINDOW) : at] if at else _PAD
                h, s, _, r = _words(lead + raw[at:end])
                own = s >= len(lead)
                found.append((h[own], s[own] - len(lead) + at, r[own]))
                at = end
            h, s, r = (np.concatenate(x) for x in zip(*found, strict=True))
            out.append((*_chunk(h, r, mean_words, max_words), s))
            continue
        if size + len(raw) > _SEGMENT:
            flush()
        pending.append(raw)
        size += len(raw) + _WINDOW
    flush()
    return out


def removed_spans(text: str, shared: set[int] | None, cuts: np.ndarray, digests: np.ndarray, starts: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(start byte, end byte, words) of every run to remove: chunks held by an earlier document or earlier in this one."""
    if not len(digests):
        return []
    repeat = np.ones(len(digests), bool)
    repeat[np.unique(digests, return_index=True)[1]] = False
    if shared:
        repeat |= np.isin(digests, np.fromiter(shared, np.int64, len(shared)))
    if not repeat.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], repeat.astype(np.int8), [0]))))
    total = len(text.encode("utf-8", "surrogatepass"))
    out = []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        first, last = cuts[a], cuts[b]
        if last - first >= min_words:
            out.append((int(starts[first]), int(starts[last]) if last < len(starts) else total, int(last - first)))
    return out


def chunk_digests(docs: DataFrame, mean_words: int = MEAN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """(digest, id) of every distinct chunk of each row; ``docs`` has columns id and text."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                own = [np.unique(d) for _, d, _ in chunk_texts(batch.column(1).to_pylist(), mean_words, max_words)]
                owner = np.repeat(np.arange(len(own)), [len(d) for d in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.empty(0, np.int64)), batch.column(0).take(pa.array(owner))], names=["digest", "id"])

    return map_batches(docs, run, f"digest bigint, id {id_type}")


def deduplicate(
    docs: DataFrame, min_words: int = MIN_WORDS, mean_words: int = MEAN_WORDS, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with repeated passages cut from the text, and, under fresh names, what was cut.

    Added: ``n_removed_words``, ``removed`` (array of start, end in code points of the original text) and ``first_in`` (ids that hold the cut chunks first).
    """
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    id_at, text_at = names[columns.index(id_col)], names[columns.index(text_col)]
    rows = chunk_digests(plain.where(F.col(id_at).isNotNull()).select(F.col(id_at).alias("id"), F.col(text_at).cast("string").alias("text")), mean_words, max_words)
    rows = staged(rows, "chunks")
    owners = rows.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("digest", "owner")
    shared = split_join(rows, owners, "digest").where("id > owner").groupBy("id").agg(F.collect_list(F.struct("digest", "owner")).alias("shared"))
    joined = plain.join(shared.withColumnRenamed("id", "__id"), F.col(id_at) == F.col("__id"), "left").drop("__id")

    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [f"`{n}` {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)]
    schema = ", ".join([*fields, "n_removed_words bigint", "removed array<struct<start:bigint,end:bigint>>", f"first_in array<{id_type}>"])
    where = names.index(text_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                texts = batch.column(where).to_pylist()
                lists = batch.column(len(names)).to_pylist()
                kept, words, spans, firsts = [], [], [], []
                for text, held, (cuts, digests, starts) in zip(texts, lists, chunk_texts(texts, mean_words, max_words), strict=True):
                    owner_of = {x["digest"]: x["owner"] for x in held or ()}
                    found = removed_spans(text or "", set(owner_of), cuts, digests, starts, min_words)
                    kept.append(text)
                    words.append(sum(w for _, _, w in found))
                    if not found:
                        spans.append([])
                        firsts.append([])
                        continue
                    raw = text.encode("utf-8", "surrogatepass")
                    parts, last, points, own = [], 0, [], set()
                    for a, b, _ in found:
                        parts.append(raw[last:a])
                        start = len(raw[:a].decode("utf-8", "surrogatepass"))
                        points.append({"start": start, "end": start + len(raw[a:b].decode("utf-8", "surrogatepass"))})
                        x, y = np.searchsorted(starts, [a, b])
                        i, j = np.searchsorted(cuts, [x, y])
                        own |= {owner_of[d] for d in digests[i:j].tolist() if d in owner_of}
                        last = b
                    parts.append(raw[last:])
                    kept[-1] = b"".join(parts).decode("utf-8", "surrogatepass")
                    spans.append(points)
                    firsts.append(sorted(own))
                arrays = [batch.column(i) for i in range(len(names))]
                arrays[where] = pa.array(kept, pa.string())
                arrays += [pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(firsts, pa.list_(batch.column(names.index(id_at)).type))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_removed_words", "removed", "first_in"])

    found = map_batches(joined, run, schema)
    extra = [x if x not in columns else f"dedup_{x}" for x in ("n_removed_words", "removed", "first_in")]
    return found.toDF(*columns, *extra)
