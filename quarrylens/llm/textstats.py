"""Whole-text statistics shared by the quality operators.

``stats_of(text)`` measures one text; ``with_stats(docs)`` adds the measures to a
DataFrame through Arrow batches.  Words are runs of anything but ASCII white space
(``[^\\x20\\x09-\\x0D]+``).  A null text measures like an empty one: all zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Measures in column order; all are long.
MEASURES = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_adjacent_repeats", "n_distinct_words", "n_upper_words", "n_bare_symbol_words", "n_symbol_words",
    "n_bang_words", "n_digit_words", "n_end_lines", "n_long_words", "max_word_chars",
)

SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = SYMBOLS.encode()
_SPACE = " \t\n\r\x0b\x0c"
_ANY_DIGIT = re.compile("[0-9]").search
_ENDS = (".", "!", "?", '"', "»", "”", "…", ":")
_LARGE_VOCABULARY = 2_000_000  # above it three ids do not fit one 64-bit code


def repeated_window_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs at least twice, its first occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    if width == 3 and size < _LARGE_VOCABULARY:
        codes = (ids[:n] * size + ids[1 : n + 1]) * size + ids[2 : n + 2]
    else:
        codes = ids[:n]
        for k in range(1, width):
            codes = np.unique(codes * size + ids[k : n + k], return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : n + k] |= hit
    return int(covered.sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = dup_lines = end_lines = 0
    known = set()
    for line in text.split("\n"):
        if bare := line.strip(_SPACE):
            lines += 1
            end_lines += bare.endswith(_ENDS)
            if line in known:
                dup_lines += 1
            else:
                known.add(line)
    upper = bare_symbol = symbol = bang = digit = long = longest = 0
    if words:
        counts = np.bincount(ids)
        sizes = np.fromiter(map(len, seen), np.int64, len(seen))
        longest, long = int(sizes.max()), int(counts[sizes > 24].sum())
        upper = int(counts[np.fromiter(map(bytes.isupper, seen), bool, len(seen)) & (sizes > 1)].sum())
        if n_symbols or "!!" in text or _ANY_DIGIT(text):
            for w, n in zip(seen, counts.tolist(), strict=True):
                if w.isalpha():
                    continue
                if not w.strip(_SYMBOL_BYTES):
                    bare_symbol += n
                elif w.rstrip(_SYMBOL_BYTES) != w or w.lstrip(_SYMBOL_BYTES) != w:
                    symbol += n
                if w.endswith(b"!!"):
                    bang += n
                elif w[:1].isdigit():
                    digit += n
    return (
        len(text), len(words), len(text) - sum(map(text.count, _SPACE)), n_symbols,
        lines, dup_lines, repeated_window_words(ids), int((ids[1:] == ids[:-1]).sum()), len(seen), upper,
        bare_symbol, symbol, bang, digit, end_lines, long, longest,
    )


def with_stats(docs: DataFrame, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row of measures for each row: the key columns, then ``MEASURES`` (long)."""
    frame = docs.select(*key_cols, docs[text_col].cast("string").alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in key_cols] + [f"{m} bigint" for m in MEASURES])
    n_keys = len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats_of(t) for t in batch.column(n_keys).to_pylist()]
            found = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            columns = [batch.column(i) for i in range(n_keys)] + [pa.array(found[:, j]) for j in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(columns, names=[*key_cols, *MEASURES])

    return map_batches(frame, run, schema)
