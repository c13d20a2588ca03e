"""Metadata files: object descriptions, rights, subscriptions, forms and report schemas to rows, read by events over a stack of tags."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .onepass import tables

ATTRIBUTES = "file string, object_name string, category string, attr_name string, attr_synonym string, attr_types array<string>, attr_kind string, ts_name string, length bigint, precision bigint, scale bigint"
RIGHTS = "file string, role_name string, object_name string, right_name string"
FORMS = "file string, kind string, scope string, element_name string, event string, handler string, data_path string"
DATASETS = "file string, dataset string, kind string, parent string, query string"
PREDEFINED = "file string, owner string, category string, name string, code string, description string, is_folder boolean, types array<string>"
ERRORS = "file string, reason string"
HANDLERS = "file string, name string, event string, handler_module string, handler_procedure string, sources array<string>"

#: XML Schema types in the dump's own names (fixed values).
BASE_TYPES = {"string": "String", "decimal": "Number", "boolean": "Boolean", "dateTime": "DateTime", "date": "Date"}
_KINDS = {"Attribute": "attribute", "Dimension": "dimension", "Resource": "resource"}


def tag_of(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def child(element: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        element = next((c for c in element if tag_of(c) == name), None)
        if element is None:
            return None
    return element


def text_of(element: ET.Element | None) -> str | None:
    return element.text.strip() if element is not None and element.text and element.text.strip() else None


def _number(element: ET.Element | None, name: str) -> int | None:
    found = next((e for e in element.iter() if tag_of(e) == name), None) if element is not None else None
    value = text_of(found)
    return int(value) if value and value.isdigit() else None


def _synonym(properties: ET.Element | None) -> str | None:
    own = child(properties, "Synonym") if properties is not None else None
    return next((text_of(e) for e in own.iter() if tag_of(e) == "content" and text_of(e)), None) if own is not None else None


def types_of(properties: ET.Element | None) -> list[str]:
    own = child(properties, "Type") if properties is not None else None
    found = [text_of(e) for e in own.iter() if tag_of(e) in ("Type", "TypeSet") and e is not own] if own is not None else []
    return [BASE_TYPES.get(t.partition(":")[2] or t, t.partition(":")[2] or t) for t in found if t]


def attributes(root: ET.Element, file: str) -> Iterator[tuple]:
    """One row for each attribute, dimension, resource and column of a tabular section."""
    top = next(iter(root), None)
    if top is None:
        return
    category, name = tag_of(top), text_of(child(top, "Properties", "Name")) or ""

    def walk(holder: ET.Element, section: str | None) -> Iterator[tuple]:
        for e in holder:
            kind, properties = tag_of(e), child(e, "Properties")
            if "uuid" not in e.attrib:
                continue
            own = text_of(child(properties, "Name")) if properties is not None else None
            if kind == "TabularSection" and (inner := child(e, "ChildObjects")) is not None:
                yield from walk(inner, own)
            elif kind in _KINDS and own:
                q = child(properties, "Type")
                yield (file, name, category, own, _synonym(properties), types_of(properties), "ts_attribute" if section else _KINDS[kind], section, _number(q, "Length"), _number(q, "Digits"), _number(q, "FractionDigits"))

    inner = child(top, "ChildObjects")
    if inner is not None:
        yield from walk(inner, None)


def rights(root: ET.Element, file: str) -> Iterator[tuple]:
    """Rights that are granted; the role is the folder that holds the file."""
    parts = file.split("/")
    role = parts[parts.index("Roles") + 1] if "Roles" in parts[:-1] else ""
    for o in root:
        if tag_of(o) == "object":
            name = text_of(child(o, "name"))
            for r in o:
                if tag_of(r) == "right" and text_of(child(r, "value")) == "true":
                    yield (file, role, name, text_of(child(r, "name")))


def form_elements(root: ET.Element, file: str) -> Iterator[tuple]:
    """Attributes, commands and handlers of a form, by the named element they stand in."""
    stack: list[tuple[ET.Element, str, bool]] = [(root, "", False)]
    while stack:
        e, owner, linked = stack.pop()
        tag, name = tag_of(e), e.attrib.get("name")
        if tag in ("Attribute", "Command") and name:
            yield (file, tag.lower(), "form", name, None, None, None)
        elif tag == "Event" and name:
            yield (file, "handler", "element" if owner else "form", owner, name, text_of(e), None)
        elif tag == "DataPath" and owner and not linked:
            yield (file, "binding", "element", owner, None, None, text_of(e))
        own = name if name and tag not in ("Attribute", "Command", "Event") else owner
        stack += [(c, own, linked or tag in ("ChoiceParameterLinks", "TypeLink")) for c in reversed(e)]


def datasets(root: ET.Element, file: str) -> Iterator[tuple]:
    """Data sets of a report schema, nested ones with their parent."""
    stack: list[tuple[ET.Element, str | None]] = [(root, None)]
    while stack:
        e, parent = stack.pop()
        own = parent
        if tag_of(e) in ("dataSet", "item") and (kind := next((v for k, v in e.attrib.items() if k.endswith("type")), "")):
            own = text_of(child(e, "name"))
            yield (file, own, kind.partition("DataSet")[2] or kind, parent, text_of(child(e, "query")))
        stack += [(c, own) for c in reversed(e)]


def split_handler(value: str | None) -> tuple[str | None, str | None]:
    """Module and procedure of ``CommonModule.M.P``; anything else has neither."""
    parts = (value or "").split(".")
    return (parts[1], parts[2]) if len(parts) == 3 and parts[0] == "CommonModule" else (None, None)


def handlers(root: ET.Element, file: str) -> Iterator[tuple]:
    """Event subscriptions and scheduled jobs."""
    for top in root:
        p = child(top, "Properties")
        if tag_of(top) not in ("EventSubscription", "ScheduledJob") or p is None:
            continue
        module, procedure = split_handler(text_of(child(p, "Handler")) or text_of(child(p, "MethodName")))
        source = child(p, "Source")
        found = [text_of(e) for e in source.iter() if tag_of(e) in ("Type", "TypeSet")] if source is not None else []
        yield (file, text_of(child(p, "Name")), text_of(child(p, "Event")), module, procedure, [t.partition(":")[2] or t for t in found if t])


def predefined(root: ET.Element, file: str) -> Iterator[tuple]:
    """Predefined items of an object, folders and what lies in them alike; the owner follows from the path ``.../Catalogs/X/Ext/Predefined.xml``."""
    if not file.endswith("Predefined.xml"):
        return
    path = file.split("/")
    owner, category = (path[-3], path[-4]) if len(path) > 3 and path[-2] == "Ext" else (None, None)
    for item in root.iter():
        if tag_of(item) != "Item":
            continue
        name, kind = text_of(child(item, "Name")), child(item, "Type")
        found = [text_of(e) for e in kind.iter() if e is not kind or not len(kind)] if kind is not None else []
        if name:
            yield (file, owner, category, name, text_of(child(item, "Code")), text_of(child(item, "Description")), (text_of(child(item, "IsFolder")) or "").lower() == "true", [t.partition(":")[2] or t for t in found if t])


PARSERS = {"predefined": (predefined, PREDEFINED), "attributes": (attributes, ATTRIBUTES), "rights": (rights, RIGHTS), "forms": (form_elements, FORMS), "datasets": (datasets, DATASETS), "handlers": (handlers, HANDLERS)}


def read_xml(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("file"), "content")


def parse(files: DataFrame, what: str) -> DataFrame:
    """Rows of one kind from (file, content); a file that is no XML gives none."""
    parser, schema = PARSERS[what]
    names = [f.strip().split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    rows += list(parser(ET.fromstring(content), file))
                except ET.ParseError:
                    continue
            out = pd.DataFrame(rows, columns=names)
            for c in ("length", "precision", "scale"):
                if c in out:
                    out[c] = out[c].astype("Int64")
            yield out

    return files.mapInPandas(run, schema)


def parse_all(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of ``PARSERS`` from one pass over (file, content), and ``errors`` (file, reason) of files that are no XML."""

    def rows_of(row: tuple) -> Iterator[tuple[str, tuple]]:
        file, content = row
        try:
            root = ET.fromstring(content)
        except ET.ParseError as e:
            yield "errors", (file, str(e))
            return
        for name, (parser, _) in PARSERS.items():
            for found in parser(root, file):
                yield name, found

    return tables(files.select("file", "content"), {name: schema for name, (_, schema) in PARSERS.items()} | {"errors": ERRORS}, rows_of)


def query_sources(query):
    """Array of (object_ref, kind) that a query's text names: VALUE(...) constants, the rest sources; comments do not count."""
    bare = F.regexp_replace(query, r"//[^\n]*", " ")
    values = F.regexp_extract_all(bare, F.lit(r"(?iu)\b(?:VALUE|ЗНАЧЕНИЕ)\s*\(\s*([\w.]+)"), F.lit(1))
    rest = F.regexp_replace(bare, r"(?iu)\b(?:VALUE|ЗНАЧЕНИЕ)\s*\([^)]*\)", " ")
    names = F.regexp_extract_all(rest, F.lit(r"(?iu)\b((?:Catalog|Document|Enum|InformationRegister|AccumulationRegister|ChartOfAccounts|Справочник|Документ|Перечисление|РегистрСведений|РегистрНакопления)\.[\w.]+)"), F.lit(1))
    as_kind = lambda kind: lambda x: F.struct(x.alias("object_ref"), F.lit(kind).alias("kind"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(values, as_kind("value")), F.transform(names, as_kind("source")))))
