"""Source modules: files to modules, methods, regions and calls, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .onepass import tables

#: Words of the language, in both spellings (fixed values).
BEGIN = {"procedure": "Procedure", "function": "Function", "процедура": "Procedure", "функция": "Function"}
END = {"endprocedure", "endfunction", "конецпроцедуры", "конецфункции"}
KEYWORDS = frozenset("if elsif else while for each do then return try except raise new and or not in to var val execute goto если иначеесли иначе пока для каждого цикл тогда возврат попытка исключение вызватьисключение новый и или не из по перем знач выполнить перейти".split())

_METHOD = re.compile(r"^\s*(?:(?:async|асинх)\s+)?(procedure|function|процедура|функция)\s+([^\W\d]\w*)\s*\(", re.I)
_END = re.compile(r"^\s*(endprocedure|endfunction|конецпроцедуры|конецфункции)\b", re.I)
_REGION = re.compile(r"^\s*#\s*(?:region|область)\s+(\w+)", re.I)
_END_REGION = re.compile(r"^\s*#\s*(?:endregion|конецобласти)\b", re.I)
_CALL = re.compile(r"(?<![\w.])((?:[^\W\d]\w*\.)*[^\W\d]\w*)\s*\(")
_EXPORT = re.compile(r"\)\s*(?:export|экспорт)\b", re.I)
_OVERRIDE = re.compile(r"^\s*&\s*(?:before|after|around|changeandvalidate|перед|после|вместо|изменениеиконтроль)\s*\(\s*\"([^\"]+)\"", re.I)

METHODS = "rel_path string, name string, type string, is_export int, params string, line bigint, end_line bigint, loc bigint, override_of string"
CALLS = "rel_path string, caller string, callee_name string, line bigint, arg_count int"
REGIONS = "rel_path string, name string, line bigint, end_line bigint"


def normalize_source(raw: bytes) -> str:
    """Text of a file: the byte order mark goes, bad bytes are replaced, every line end is a line feed."""
    return raw.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def strip_code(text: str) -> str:
    """The text with comments gone and strings blank, each line at its length: what is left is code."""
    out, in_string = [], False
    for line in text.split("\n"):
        chars, i = [], 0
        if in_string and not line.lstrip().startswith("|"):
            in_string = line.lstrip().startswith("//") and in_string
        while i < len(line):
            c = line[i]
            if in_string:
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        chars.append("  ")
                        i += 2
                        continue
                    in_string = False
                    chars.append('"')
                else:
                    chars.append(" ")
            elif c == '"':
                in_string = True
                chars.append('"')
            elif c == "/" and line[i + 1 : i + 2] == "/":
                break
            else:
                chars.append(c)
            i += 1
        out.append("".join(chars))
    return "\n".join(out)


def brackets(code: str) -> dict[int, tuple[int, int]]:
    """For every opening bracket of the code its closing one (the code's length if there is none) and the arguments between them.

    Arguments are the commas at the bracket's own depth and one, none for empty brackets.  One pass, however long a call is.
    """
    found: dict[int, tuple[int, int]] = {}
    open_now: list[list] = []

    def close(at: int) -> None:
        start, commas, seen = open_now.pop()
        found[start] = at, commas + 1 if seen or commas else 0

    for at, c in enumerate(code):
        if c in "([{":
            if open_now:
                open_now[-1][2] = True
            open_now.append([at, 0, False])
        elif not open_now:
            continue
        elif c in ")]}":
            close(at)
        elif c == ",":
            open_now[-1][1] += 1
        elif not c.isspace():
            open_now[-1][2] = True
    while open_now:
        close(len(code))
    return found


def parse_module(text: str) -> dict[str, list]:
    """methods, calls and regions of one module; calls outside methods are no edges."""
    lines, whole = text.split("\n"), strip_code(text)
    code, ends, at = whole.split("\n"), brackets(whole), 0
    methods, calls, regions, open_regions, now, pending = [], [], [], [], None, None
    for n, (raw, line) in enumerate(zip(lines, code, strict=True), 1):
        first, at = at, at + len(line) + 1  # where the line and the next one begin
        if m := _REGION.match(line):
            open_regions.append([m[1], n, None])
            regions.append(open_regions[-1])
            continue
        if _END_REGION.match(line):
            if open_regions:
                open_regions.pop()[2] = n
            continue
        if m := _OVERRIDE.match(raw):
            pending = m[1]
            continue
        if m := _METHOD.match(line):
            start = first + m.end() - 1
            end = ends[start][0]
            end = first + len(line) if end == len(whole) else end  # never closed: it ends with its line
            now = {"name": m[2], "type": BEGIN[m[1].lower()], "is_export": int(bool(_EXPORT.match(whole, end))), "params": re.sub(r"\s+", " ", whole[start + 1 : end]).strip(), "line": n, "end_line": None, "override_of": pending}
            pending = None
            methods.append(now)
            continue
        if _END.match(line):
            if now:
                now["end_line"] = n
            now = None
            continue
        if now:
            for m in _CALL.finditer(line):
                name = m[1]
                if "." not in name and name.lower() in KEYWORDS:
                    continue
                if re.search(r"(?i)\b(?:new|новый)\s+$", line[: m.start()]):
                    continue
                calls.append((now["name"], name, n, ends[first + m.end() - 1][1]))
    for m in methods:
        m["end_line"] = m["end_line"] or len(lines)
        m["loc"] = m["end_line"] - m["line"] + 1
    return {"methods": methods, "calls": calls, "regions": [tuple(r) for r in regions]}


def complexity(text: str) -> tuple[int, int]:
    """(cyclomatic number, deepest nesting) of a piece of code."""
    cyclomatic, depth, deepest = 1, 0, 0
    for line in strip_code(text).lower().split("\n"):
        words = re.findall(r"[^\W\d]\w*", line)
        cyclomatic += sum(w in ("if", "elsif", "while", "for", "except", "and", "or", "если", "иначеесли", "пока", "для", "исключение", "и", "или") for w in words)
        for w in words:
            if w in ("if", "while", "for", "try", "если", "пока", "для", "попытка"):
                depth += 1
                deepest = max(deepest, depth)
            elif w in ("endif", "enddo", "endtry", "конецесли", "конеццикла", "конецпопытки"):
                depth = max(0, depth - 1)
    return cyclomatic, deepest


def read_modules(spark: SparkSession, root: str, pattern: str = "*.[bB][sS][lL]") -> DataFrame:
    """(rel_path, content) of every module file under ``root``; rel_path begins below the whole of ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring("path", len(whole) + 2, 1 << 30).alias("rel_path"), "content")


def parse(modules: DataFrame, what: str) -> DataFrame:
    """``methods``, ``calls`` or ``regions`` of every module; ``modules``: (rel_path, content)."""
    schema = {"methods": METHODS, "calls": CALLS, "regions": REGIONS}[what]
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["rel_path"], pdf["content"], strict=True):
                text = normalize_source(content) if isinstance(content, (bytes, bytearray)) else content or ""
                for r in parse_module(text)[what]:
                    rows.append((path, *[r.get(k) for k in names[1:]]) if isinstance(r, dict) else (path, *r))
            yield pd.DataFrame(rows, columns=names)

    return modules.select("rel_path", "content").mapInPandas(run, schema)


def parse_all(modules: DataFrame) -> dict[str, DataFrame]:
    """``methods``, ``calls`` and ``regions`` from one pass over (rel_path, content)."""
    schemas = {"methods": METHODS, "calls": CALLS, "regions": REGIONS}
    names = {k: [f.strip().split()[0] for f in s.split(",")] for k, s in schemas.items()}

    def rows_of(row: tuple) -> Iterator[tuple[str, tuple]]:
        path, content = row
        text = normalize_source(content) if isinstance(content, (bytes, bytearray)) else content or ""
        for table, rows in parse_module(text).items():
            for r in rows:
                yield table, (path, *[r.get(k) for k in names[table][1:]]) if isinstance(r, dict) else (path, *r)

    return tables(modules.select("rel_path", "content"), schemas, rows_of)


#: Folder of a dump to its metadata kind (fixed values).
KIND_OF_CATEGORY = {
    "AccountingRegisters": "AccountingRegister", "AccumulationRegisters": "AccumulationRegister", "BusinessProcesses": "BusinessProcess", "CalculationRegisters": "CalculationRegister",
    "Catalogs": "Catalog", "ChartsOfAccounts": "ChartOfAccounts", "ChartsOfCalculationTypes": "ChartOfCalculationTypes", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes",
    "CommonModules": "CommonModule", "Constants": "Constant", "DataProcessors": "DataProcessor", "DocumentJournals": "DocumentJournal", "Documents": "Document", "Enums": "Enum",
    "ExchangePlans": "ExchangePlan", "InformationRegisters": "InformationRegister", "Reports": "Report", "Tasks": "Task",
}


def classify_path(path):
    """Columns category, object_name, form_name, module_type, is_form of a module path."""
    parts = F.split(path, "/")
    file = F.regexp_replace(F.element_at(parts, -1), r"(?i)\.bsl$", "")
    at = F.array_position(parts, "Forms")
    return {
        "category": F.when(F.size(parts) > 1, parts[0]),
        "object_name": F.when(F.size(parts) > 2, parts[1]),
        "form_name": F.when(at > 0, F.get(parts, at.cast("int"))),
        "module_type": F.when((at > 0) & (F.lower(file) == "module"), "FormModule").otherwise(file),
        "is_form": (at > 0).cast("int"),
    }
