"""Calls in methods with what surrounds them: blocks, arguments, the call they are an argument of, concatenation.

The lexer gives facts only (tokens of arguments by kind, the root of a qualified name); names against known modules and the
descriptions of literals are columns over its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.stage import dealt, tasks
from .modules import KEYWORDS, normalize_source, parse_module

EVENTS = (
    "rel_path string, method string, method_line bigint, pos int, line bigint, name string, root string, flags string, try_id int, "
    "first_kind string, args array<struct<kind:string,value:string>>, concat boolean, parent string"
)

_TOKEN = re.compile(r"""(?P<skip>//[^\n]*|(?m:^[ \t]*[#&][^\n]*))|(?P<S>"(?:[^"\n]|""|\n[ \t]*\|)*"?)|(?P<N>\d+(?:\.\d+)?|'[^'\n]*')|(?P<I>[^\W\d]\w*)|(?P<O><>|<=|>=|\S)""")

#: Words that stand for values (fixed values).
LITERALS = frozenset("true false undefined null истина ложь неопределено".split())
NEW, RAISE, VALUE = ("new", "новый"), ("raise", "вызватьисключение"), ("val", "знач")
#: Names of the two events that are no calls (fixed values).
NEW_NAME, RAISE_NAME = "Новый ", "ВызватьИсключение"

#: What a block word does: (a block that it ends if it stands on top, blocks up to which it closes, the block it opens).
#: B branch, C condition, L loop, T attempt, X handler; a word that closes up to a block that is not open does nothing.
_BLOCKS = {
    "try": ("", "", "T"), "except": ("", "T", "X"), "endtry": ("", "TX", ""), "if": ("", "", "C"), "elsif": ("B", "", "C"), "then": ("C", "", "B"),
    "endif": ("", "BC", ""), "while": ("", "", "C"), "do": ("C", "", "L"), "enddo": ("", "L", ""),
}
_BLOCKS |= {
    "попытка": _BLOCKS["try"], "исключение": _BLOCKS["except"], "конецпопытки": _BLOCKS["endtry"], "если": _BLOCKS["if"], "иначеесли": _BLOCKS["elsif"], "тогда": _BLOCKS["then"],
    "конецесли": _BLOCKS["endif"], "пока": _BLOCKS["while"], "цикл": _BLOCKS["do"], "конеццикла": _BLOCKS["enddo"],
}


class Blocks:
    """The blocks that are open at a place."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = []
        self.attempts = 0

    def word(self, word: str) -> None:
        top, upto, opens = _BLOCKS[word]
        number = 0
        if upto:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in upto), None)
            if at is None:
                return
            number = self.open[at][1]
            del self.open[at:]
        if top and self.open and self.open[-1][0] == top:
            self.open.pop()
        if opens == "T":
            self.attempts += 1
            number = self.attempts
        if opens:
            self.open.append((opens, number))

    def state(self) -> tuple[str, int | None]:
        """Letters of the open blocks, each once, and the number of the nearest attempt."""
        return "".join(sorted({k for k, _ in self.open})), next((n for k, n in reversed(self.open) if k in "TX"), None)


def tokens(code: str) -> list[tuple[str, str, int]]:
    """(kind, value, line below the first) of strings, numbers and dates, names, and signs."""
    out, line, at = [], 0, 0
    for m in _TOKEN.finditer(code):
        line += code.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], line))
    return out


def _pairs(found: list[tuple[str, str, int]]) -> dict[int, int]:
    """The closing bracket of every opening one that has any."""
    pairs, open_now = {}, []
    for i, (kind, value, _) in enumerate(found):
        if kind == "O" and value in "([":
            open_now.append(i)
        elif kind == "O" and value in ")]" and open_now:
            pairs[open_now.pop()] = i
    return pairs


def _is_chain(part: list[tuple[str, str, int]]) -> bool:
    return len(part) % 2 == 1 and all(t[0] == "I" for t in part[::2]) and all(t[1] == "." for t in part[1::2])


def _argument(found: list, pairs: dict[int, int], a: int, b: int) -> dict[str, str | None]:
    """What the tokens from ``a`` to ``b`` are: nothing (-), text (S), number or date (N), a literal word (=), a name (I), a dotted name (D), one call (C), or an expression (E)."""
    part = found[a:b]
    if not part:
        return {"kind": "-", "value": None}
    kinds = {t[0] for t in part}
    if kinds == {"S"}:
        return {"kind": "S", "value": "".join(t[1] for t in part)}
    if len(part) == 1 and part[0][0] == "N":
        return {"kind": "N", "value": part[0][1]}
    if _is_chain(part):
        low = part[-1][1].lower()
        return {"kind": "D" if len(part) > 1 else "=" if low in LITERALS else "I", "value": low}
    opening = next((i for i in range(a, b) if found[i][1] == "(" and found[i][0] == "O"), None)
    if opening is not None and pairs.get(opening) == b - 1 and _is_chain(found[a:opening]):
        return {"kind": "C", "value": found[opening - 1][1]}
    return {"kind": "E", "value": None}


def _arguments(found: list, pairs: dict[int, int], opening: int) -> tuple[list[dict], str]:
    """The first four arguments, none for empty brackets, and the kind of the first."""
    closing = pairs.get(opening, len(found))
    edges, i = [opening], opening + 1
    while i < closing and len(edges) < 5:
        if found[i][0] == "O" and found[i][1] == ",":
            edges.append(i)
        i = pairs.get(i, i) + 1
    if len(edges) < 5:
        edges.append(closing)
    args = [_argument(found, pairs, a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
    kind = args[0]["kind"]
    if opening + 1 < closing and found[opening + 1][0] == "N":
        kind = "N"
    first = "=" + args[0]["value"] if kind == "=" else kind if kind in "-SNI" else "E"
    return ([] if len(args) == 1 and kind == "-" else args), first


def events_of(body: str) -> Iterator[dict]:
    """Events of one method's text, its heading first; a call is joined if a plus stands right before its name or right after its bracket."""
    found = tokens(body)
    pairs = _pairs(found)
    heading = next((i for i, t in enumerate(found) if t[1] == "("), None)
    if heading is None or heading not in pairs:
        return
    parameters = {found[i][1].lower() for i in range(heading + 1, pairs[heading]) if found[i][0] == "I" and (found[i - 1][1] in "(," or found[i - 1][1].lower() in VALUE)}
    blocks, around = Blocks(), []  # around: name of the call at every open bracket, or None
    i, n, pos = pairs[heading] + 1, len(found), 0

    def sign(at: int) -> str:
        return found[at][1] if 0 <= at < n and found[at][0] == "O" else ""

    while i < n:
        kind, value, line = found[i]
        low = value.lower()
        event, opening = None, None
        if kind == "O":
            if value in "([":
                around.append(None)
            elif value in ")]" and around:
                around.pop()
        elif kind == "I" and low in _BLOCKS:
            blocks.word(low)
        elif kind == "I" and low in NEW and i + 1 < n and found[i + 1][0] == "I":
            opening = i + 2 if sign(i + 2) == "(" else None
            event = {"name": NEW_NAME + found[i + 1][1], "root": None}
            last = i + 1
        elif kind == "I" and low in RAISE:
            event, last = {"name": RAISE_NAME, "root": None, "args": [], "first_kind": "E" if sign(i + 1) == "(" else "-", "parent": "", "concat": False}, i
        elif kind == "I" and (low not in KEYWORDS or sign(i - 1) == "."):
            last = i
            while sign(last + 1) == "." and last + 2 < n and found[last + 2][0] == "I":
                last += 2
            if sign(last + 1) == "(":
                opening, method = last + 1, found[last][1]
                if sign(i - 1) == ".":
                    event = {"name": f"*.{method}", "root": None}
                elif last == i:
                    event = {"name": method, "root": None}
                elif low in parameters:
                    event = {"name": f"param:{value}.{method}", "root": None}
                else:
                    event = {"name": f"{value}.{method}", "root": value if last == i + 2 else ""}
            else:
                i = last + 1
                continue
        if event is None:
            i += 1
            continue
        flags, attempt = blocks.state()
        args, first = _arguments(found, pairs, opening) if opening is not None else ([], "-")
        end = last if opening is None else pairs.get(opening, n)
        parent = next((x for x in reversed(around) if x), "")
        yield {"pos": pos, "line": line, "flags": flags, "try_id": attempt, "first_kind": first, "args": args, "parent": parent, "concat": "+" in (sign(i - 1), sign(end + 1))} | event
        pos += 1
        if opening is not None:
            around.append(event["name"])
        i = last + 1 if opening is None else opening + 1


def events(modules: DataFrame, size: int = 2000) -> DataFrame:
    """``EVENTS`` of every method of (rel_path, content); a file of many modules is dealt to many tasks."""
    schema = StructType.fromDDL(EVENTS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = normalize_source(content) if isinstance(content, bytes) else content or ""
                lines = text.split("\n")
                for m in parse_module(text)["methods"]:
                    own = {"rel_path": path, "method": m["name"], "method_line": m["line"]}
                    for e in events_of("\n".join(lines[m["line"] - 1 : m["end_line"]])):
                        held.append(own | e | {"line": e["line"] + m["line"]})
                if len(held) >= size:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    rows = modules.select("rel_path", "content")
    return dealt(rows, "rel_path", n=tasks(rows, kb=16)).mapInArrow(run, schema)


def named(found: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Events whose qualified names have a known module for a root; what hangs on anything else is called ``*.Method``."""
    modules = known.select(F.lower(F.col(name)).alias("__k")).distinct()
    joined = found.join(modules, F.lower("root") == F.col("__k"), "left")
    method = F.element_at(F.split("name", r"\."), -1)
    return joined.withColumn("name", F.when(F.col("root").isNotNull() & F.col("__k").isNull(), F.concat(F.lit("*."), method)).otherwise(F.col("name"))).drop("__k")


def described(argument: Column) -> Column:
    """One string for an argument: its kind, with the name, the literal word, the called function, or the description of a text."""
    kind, value = argument["kind"], argument["value"]
    return (
        F.when(kind == "S", T.literal_description(value)).when(kind.isin("I", "D"), F.concat(F.lit("I:"), value))
        .when(kind == "C", F.concat(F.lit("C:"), value)).when(kind == "=", F.concat(F.lit("="), value)).otherwise(kind)
    )
