"""Text expressions: Column in, Column out, no Python in the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CYRILLIC = r"Ѐ-ԯ"
_SCRIPTS = (rf"&&[{_CYRILLIC}]", rf"&&[^{_CYRILLIC}]")
#: By script: an acronym before a capitalised word, a capitalised or lower word, capitals; then digits.
_WORD = (
    "|".join(rf"[\p{{Lu}}{s}]+(?=[\p{{Lu}}{s}][\p{{Ll}}{s}])|[\p{{Lu}}{s}]?[\p{{L}}{s}&&[^\p{{Lu}}]]+|[\p{{Lu}}{s}]+" for s in _SCRIPTS)
    + r"|\p{N}+"
)


def tokenize_name(name: Column, min_length: int = 2) -> Column:
    """Words of an identifier, lower-cased, in order, duplicates kept; split at case, alphabet, digit and separator changes."""
    words = F.regexp_extract_all(name, F.lit(_WORD), F.lit(0))
    return F.transform(F.filter(words, lambda w: F.length(w) >= min_length), lambda w: F.lower(w))


def same(a: Column, b: Column | str) -> Column:
    """Equality without regard to case, in any script."""
    return F.lower(a) == (b.lower() if isinstance(b, str) else F.lower(b))


def has(a: Column, part: str) -> Column:
    """Substring without regard to case; the part is literal."""
    return F.contains(F.lower(a), F.lit(part.lower()))


def self_or_element(path: Column, full: str) -> Column:
    """The object itself or something inside it; names that only share a prefix do not match."""
    return (path == full) | path.startswith(full + ".")


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased text; none for a shorter text."""
    low = F.lower(text)
    return F.when(
        F.length(low) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the larger set's size."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def name_precision(name: Column, query: str) -> Column:
    """1 for the name itself, 0.5 for a prefix, 0.25 for a part, else 0."""
    low, q = F.lower(name), query.lower()
    return F.when(low == q, 1.0).when(low.startswith(q), 0.5).when(F.contains(low, F.lit(q)), 0.25).otherwise(0.0)


def lexical_weight(text: Column, terms: list[str]) -> Column:
    """Summed lengths of the terms that the text holds."""
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(t.lower())), len(t)).otherwise(0) for t in terms), F.lit(0)).cast("long")


def match_count(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)).cast("long")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Entities that help pages use, in the order in which they are decoded (fixed values).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def html_to_text(html: Column) -> Column:
    """Drop scripts, styles and comments, break at block ends, drop tags, decode six entities, squeeze white space."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def path_parts(path: Column) -> dict[str, Column]:
    """Directory, file name, extension and depth of a slash-separated path."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return {
        "dir_path": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"),
        "filename": name,
        "extension": F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))).otherwise(""),
        "depth": (F.size(parts) - 1).cast("long"),
    }


def short_name(name: Column) -> Column:
    """What follows the first dot, or the name itself."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)


def stem(word: Column, longer_than: int = 5, cut: int = 2) -> Column:
    """Drop the last letters of a long word."""
    return F.when(F.length(word) > longer_than, F.left(word, F.length(word) - cut)).otherwise(word)


#: Longer than a type's name: suffixes that mean the same object (fixed values).
TYPE_SUFFIXES = ("ValueManager", "RecordSet", "Manager", "Object", "Ref")


def normalize_type(ref: Column) -> Column:
    """``CatalogRef.X`` and its kin to ``Catalog.X``; others unchanged."""
    return F.regexp_replace(ref, r"^([A-Za-z]+?)(?:" + "|".join(TYPE_SUFFIXES) + r")\.", "$1.")


#: Singular and reference-type heads of object names with their category; a head with a suffix names a type (fixed values).
OBJECT_HEADS = {
    "справочник": "Catalog", "документ": "Document", "перечисление": "Enum", "отчет": "Report", "обработка": "DataProcessor", "регистрсведений": "InformationRegister", "регистрнакопления": "AccumulationRegister",
    "catalog": "Catalog", "document": "Document", "enum": "Enum", "report": "Report", "dataprocessor": "DataProcessor", "informationregister": "InformationRegister", "accumulationregister": "AccumulationRegister",
}
OBJECT_SUFFIXES = ("ссылка", "объект", "менеджер", "выборка", "список", "ref", "object", "manager", "selection", "list")


def mentions(text: Column) -> Column:
    """Objects that a literal or query names, as structs (object_ref, member, kind).

    Words are cut at all that cannot stand in a name; the head before the first dot must name a category, alone (``query``,
    with one member segment) or with a type suffix (``ref_type``), and an identifier must follow.
    """
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_.]+"), lambda w: F.contains(w, F.lit(".")))
    suffix = "(?:" + "|".join(OBJECT_SUFFIXES) + ")"
    heads = F.create_map(*[F.lit(x) for pair in OBJECT_HEADS.items() for x in pair])

    def one(w: Column) -> Column:
        parts = F.split(w, r"\.")
        head = F.lower(parts[0])
        typed = head.rlike(rf"^(?:{'|'.join(OBJECT_HEADS)}){suffix}$")
        category = F.try_element_at(heads, F.when(typed, F.regexp_replace(head, rf"{suffix}$", "")).otherwise(head))
        member = F.when(~typed & (F.size(parts) > 2) & (F.try_element_at(parts, F.lit(3)) != ""), F.try_element_at(parts, F.lit(3)))
        ref = F.when(F.try_element_at(parts, F.lit(2)).rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.concat(category, F.lit("."), parts[1]))
        return F.struct(ref.alias("object_ref"), member.alias("member"), F.when(typed, "ref_type").otherwise("query").alias("kind"))

    return F.filter(F.transform(words, one), lambda m: m["object_ref"].isNotNull())


def json_strings(values: Column) -> Column:
    """An array of strings as a JSON array; null elements stay null."""
    return F.to_json(values)


def strings_of_json(text: Column) -> Column:
    """The strings of a JSON array; null where it is none."""
    return F.from_json(text, "array<string>")


def relative_to_source(path: Column, source: str) -> Column:
    """A file's path below ``source``; a neighbour's (an extension's) begins with ``../``; others stay whole."""
    root = source.rstrip("/")
    above = root.rsplit("/", 1)[0]
    return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).when(F.startswith(path, F.lit(above + "/")), F.concat(F.lit("../"), F.substring(path, len(above) + 2, 1 << 30))).otherwise(path)


def extension_of(rel_path: Column) -> Column:
    """Name of the extension that a relative path lies in: ``../ext/Name/...`` or ``../cfe/Name/...``; null for the base."""
    return F.nullif(F.regexp_extract(rel_path, r"^\.\./(?:ext|cfe)/([^/]+)/", 1), F.lit(""))


def literal_shape(text: Column) -> Column:
    """Letters to a, digits to 0, runs to one, separators kept."""
    out = F.regexp_replace(text, r"[\p{L}]+", "a")
    return F.regexp_replace(out, r"[0-9]+", "0")


def literal_keys(text: Column) -> Column:
    """The first six names in order that stand before an equals sign in a literal."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-zА-Яа-яЁё]+)\s*="), F.lit(1)))), 1, 6)


def literal_description(literal: Column) -> Column:
    """``S:coarse~shape|k=keys`` of a quoted literal: its form without names and spaces (24 characters), letters and digits as one each (40), and its keys."""
    body = F.replace(F.trim(literal, F.lit('"')), F.lit('""'), F.lit('"'))

    def steps(value: Column, *pairs: tuple[str, str]) -> Column:
        for pattern, to in pairs:
            value = F.regexp_replace(value, pattern, to)
        return value

    shape = F.left(steps(body, ("[A-Za-zА-Яа-яЁё]+", "a"), (r"\d+", "9"), (r"\s+", " ")), F.lit(40))
    coarse = F.left(steps(body, ("'[^']*'?", "'…'"), ("[A-Za-zА-Яа-яЁё_][0-9A-Za-zА-Яа-яЁё_]*", "a"), (r"\d+", "9"), (r"\s+", ""), (r"a(?:\s*a)+", "a")), F.lit(24))
    keys = literal_keys(body)
    return F.concat(F.lit("S:"), coarse, F.lit("~"), shape, F.when(F.size(keys) > 0, F.concat(F.lit("|k="), F.array_join(keys, ","))).otherwise(F.lit("")))
