"""Exact BPE by dynamic programming over prefixes, and decoding.

For every prefix of a word the merges leave one unique last token.  An automaton over the vocabulary
(states are the longest suffixes that begin a token, linked to shorter ones) lists all tokens that end
at each position; among them the last token of the prefix is the one that the last token of the prefix
before it may stand next to.  Two tokens may stand side by side if the merges that formed them, undone
from the seam outwards in reverse order, never meet a merge across the seam that would have come first.
Back-pointers then give the ids.  Texts are normalised and split into words as the vocabulary's own file
says; words are memoised per worker.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded
one by one; a null key is carried; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHE_ENTRIES = 500_000  # about 100 MB a worker for each of two caches
_ODD_SPACES = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[\x21-\x7e\xa1-\u017f]+").fullmatch
_END_BASE = 0xF0000  # private-use code points stand for a word's last symbol
_codecs: dict[str, Codec] = {}


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(spare))
        spare += b not in own
    return out


class Codec:
    """Encoder and decoder of one vocabulary file (a BPE with an end-of-word suffix, split by a pattern)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("[^\\s", "[^ ")).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.strings = np.full(size, "", object)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.strings[i] = t

        ids = model["vocab"]
        #: rank of the merge of a pair of ids, and the pair and rank that made each id
        self.merges: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = (ids[a], ids[b])
            self.merges[key] = rank
            self.made.setdefault(ids[a + b], (*key, rank))
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if symbols := self._symbols(t, byte_of):
                if i in self.made or len(symbols) == 1:
                    self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.cache: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}

    def _symbols(self, token: str, byte_of: dict[str, int]) -> str:
        """A token with one character for each byte, the last one of a word in the private range."""
        ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
        body = token[: -len(self.suffix)] if ends else token
        if not all(c in byte_of for c in body):
            return ""
        codes = [byte_of[c] for c in body]
        if ends:
            codes[-1] += _END_BASE
        return "".join(map(chr, codes))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` as they are when they stand side by side."""
        key = (a, b)
        if (found := self.known.get(key)) is None:
            found = self._compatible(a, b)
            if len(self.known) > 2_000_000:
                self.known.clear()
            self.known[key] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        merges, made = self.merges, self.made
        # the last merge undone so far at the seam; one across it must come before that to have happened
        bound, left_side = len(merges), False
        while True:
            across = merges.get((a, b))
            # equal ranks merge from the left: one undone on the left came first, one undone on the right came after
            if across is not None and (across < bound or across == bound and not left_side):
                return False
            of_a, of_b = made.get(a), made.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a[2] > of_b[2]:
                a, bound, left_side = of_a[1], of_a[2], True
            else:
                b, bound, left_side = of_b[0], of_b[2], False

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        n = len(raw)
        symbols = raw.decode("latin-1")
        if self.suffix:
            symbols = symbols[:-1] + chr(_END_BASE + raw[-1])
        last: list[int] = [-1] * (n + 1)  # the last token of each prefix, -1: no tokens lead here
        back = [0] * (n + 1)
        known, compatible = self.known, self.compatible
        done = -1
        for at, (token, size) in self.automaton.iter(symbols):
            if at == done:
                continue
            start = at + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known.get((before, token))
                if fits is None:
                    fits = compatible(before, token)
                if not fits:
                    continue
            done = at
            last[at + 1], back[at + 1] = token, start
        out = []
        at = n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def word_bytes(self, word: str) -> bytes:
        """The ids of one word as bytes, memoised: chunks differ in punctuation and case more than in words."""
        found = self.by_word.get(word)
        if found is None:
            found = array("I", self.word_ids(word)).tobytes()
            if len(word) <= 32:
                if len(self.by_word) >= _CACHE_ENTRIES:
                    self.by_word.clear()
                self.by_word[word] = found
        return found

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a text without white space at which words could meet, as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        if _PLAIN(chunk):  # composed already, and lower-cased alike by all libraries
            lower = chunk.lower()
            if lower.isalpha():
                return self.word_bytes(lower)
            if "<|" not in chunk:
                return b"".join([self.word_bytes(w) for w in self.words(lower)])
        for part in self.split_special(chunk) if self.split_special else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self.words(self.normalize(part)):
                    out += self.word_ids(word)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        cache = self.cache
        chunks = [text] if _ODD_SPACES.search(text) else text.split()
        try:
            return b"".join([cache[c] for c in chunks])
        except KeyError:
            pass
        out = []
        for c in chunks:
            if (found := cache.get(c)) is None:
                found = self.chunk_ids(c)
                if len(c) <= 64:
                    if len(cache) >= _CACHE_ENTRIES:
                        cache.clear()
                    cache[c] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by spaces, special tokens included."""
        return " ".join(self.strings[np.frombuffer(ids, "<u4")].tolist())


def codec(path: str) -> Codec:
    if path not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",), decode_too: bool = False) -> DataFrame:
    """Key columns and ``ids`` (little-endian unsigned 32-bit, as one binary); with ``decode_too`` also ``decoded``."""
    frame = docs.select(*key_cols, docs[text_col].cast("string").alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in key_cols] + ["ids binary"] + ["decoded string"] * decode_too)
    n_keys = len(key_cols)
    names = [*key_cols, "ids"] + ["decoded"] * decode_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [own.encode(t) for t in batch.column(n_keys).to_pylist()]
                columns = [batch.column(i) for i in range(n_keys)] + [pa.array(ids, pa.binary())]
                if decode_too:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns and ``decoded`` from the ``ids`` of ``encode()``."""
    frame = encoded.select(*key_cols, F.col(ids_col).alias("__ids"))
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    n_keys = len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path)
        for batch in batches:
            texts = [own.decode(x or b"") for x in batch.column(n_keys).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_keys)] + [pa.array(texts, pa.string())], names=[*key_cols, "decoded"])

    return frame.mapInArrow(run, ", ".join([f"`{k}` {types[k]}" for k in key_cols] + ["decoded string"]))
