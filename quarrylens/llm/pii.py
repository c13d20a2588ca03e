"""Personal data by weak supervision, in DataFrame and SQL functions only.

1. Base spans: four fixed patterns (email, ip, card, phone) with their checks.
2. Candidates: wider patterns for what the base leaves out (secrets: access keys, tokens, passwords; ids in
   groups of digits; emails and phones in other spellings).  Regex, gazetteer and context labelers vote on
   each candidate: +1 personal, -1 not, 0 abstain.  Context is what stands before and after a candidate and whether
   a base span is near.
3. Expectation-maximisation over the table of vote patterns (at most 3 ** labelers rows, whatever the input)
   estimates each labeler's reliabilities without labels.
4. A final span classifier: a logistic model of span features, fitted to the EM posteriors over the counts of
   feature patterns, scores each candidate as a column expression.  Candidates above the threshold that do not
   touch a base span are added; base spans always stay.

The texts are searched once: keys and spans are written to the shared folder, the model is fitted on them, and the
result is a filter on that table.

Offsets are code points: pieces between matches come from one split of the text by the pattern, and running
lengths give positions.  Start positions are anchored (a run of characters is entered once), so long runs
without a match cost linear time and give what unanchored leftmost matching gives.  Spans are walked in blocks, so that
a text with very many of them does not copy its list again at each.

Defined cases: null texts are empty texts; an empty text has no spans; a null key is carried; repeated rows
are searched one by one; an empty table gives an empty result; without any candidate the model adds nothing; other
columns are carried by ``redact`` under their own names, whatever they are, and not by ``find``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")

#: Anchored forms of the base patterns: each can only start where leftmost matching would enter its run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text can only match where it holds this.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Candidate kinds beyond the base.  Lengths are open where the span's are; the three-part token comes first and
#: enters a run of its characters once, so that long runs (a line of dashes) cost linear time.
WIDER = {
    "secret": r"(?<![A-Za-z0-9_])(?:(?<!-)[A-Za-z0-9_-]{20,}+\.[A-Za-z0-9_-]{20,}+\.[A-Za-z0-9_-]{20,}+|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}+[\"']?|[0-9a-f]{32,}+(?![0-9A-Za-z]))",
    "id_number": r"(?<![0-9A-Za-z.,+-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}|[0-9](?:[\x20-]?[0-9]){8,18})(?![0-9A-Za-z])",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z]{2,24}){1,4}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: A text can only hold a candidate of the kind where it matches this: each is a part of every alternative of the pattern above.
WIDER_NEEDS = {
    "secret": r"AKIA|ASIA|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]|[0-9a-f]{32}|[A-Za-z0-9_-]{20}\.[A-Za-z0-9_-]{20}",
    "id_number": r"[0-9](?:[\x20-]?[0-9]){8}|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "hidden_email": r"\(at\)|\[at\]|\{at\}|\x20at\x20",
    "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}",
}

#: Words that name personal data or credentials nearby, or a label of any kind right before (fixed values).
CONTEXT = r"(?i)(?:phone|tel|mobile|call|fax|mail|contact|reach|ssn|iban|account|passport|password|secret|token|key|login|user|write\x20to)[^A-Za-z]{0,12}(?:(?:is|me|us|at|:)[^A-Za-z]{1,4})?$|[A-Za-z]\x20?[:=]\x20?[\"']?$"
#: Words that introduce quantities rather than identities (fixed values), or a running sentence.
ANTI_CONTEXT = r"(?i)(?:page|pages|chapter|figure|table|version|section|line|isbn|issue|vol|no|order|item|total)[.:#\x20]{0,3}$"
SENTENCE = r"(?:^|[^\p{L}])\p{Ll}+,?\x20\p{Ll}+,?\x20$"
#: What follows a quantity, and a sentence that goes on inside or after a span (fixed values).
AFTER = r"^\x20?(?:%|kg|km|mm|cm|pages|times|items|percent|bytes)(?![A-Za-z])"
#: Public example values that identify nobody (fixed values).
EXAMPLES = r"(?i)^(?:password|passwd|pwd|secret|token)\s*[=:]\s*[\"']?(?:password|changeme|example|none|null|true|false|required|hidden|x+|\*+)[\"']?$"

LABELERS = ("shape", "structure", "gazetteer", "context", "anti_context", "sentence", "neighbours", "randomness")
THRESHOLD = 0.5


#: Items that a fold gathers before it appends them to its result, and code points of a text that are cut at once.
BLOCK, CHUNK = 128, 4096
#: Code points between a candidate and a base span that count as near.
NEAR = 120


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _fold(items: Column, state: Column, step, out_type: str) -> Column:
    """The outputs of ``step(state, item)``, a struct of (state, out), over an array; gathered in blocks, since every append copies."""
    none = F.array().cast(f"array<{out_type}>")

    def blocks_of(whole: Column) -> Column:
        last = F.greatest(F.floor((F.size(whole) - 1) / BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))

    def one(acc: Column, item: Column) -> Column:
        return _let(step(acc["state"], item), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def many(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    return F.aggregate(_let(items, blocks_of), F.struct(state.alias("state"), none.alias("out")), many)["out"]


def _pieces(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end in code points, value)."""
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(at: Column, x: Column) -> Column:
        a = at + F.length(x["0"])
        b = a + F.coalesce(F.length(x["1"]), F.lit(0))
        span = F.struct(a.alias("start"), b.alias("end"), x["1"].alias("value"))
        return F.struct(b.cast("long").alias("state"), span.alias("out"))

    pairs = F.arrays_zip(between.alias("0"), values.alias("1"))
    found = _fold(pairs, F.lit(0).cast("long"), step, "struct<start:bigint,end:bigint,value:string>")
    return F.filter(found, lambda s: s["value"].isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    reversed_digits = F.split(F.reverse(_digits(value)), "(?!^)(?!$)")
    weighed = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
_NONE = "array<struct<start:bigint,end:bigint,value:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """The kind's base spans of a text column; only texts that can match are searched."""
    pattern = BASE[kind]
    can = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}") if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
    if kind == "ip":
        can = text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "email":
        can = can & text.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]")
    if kind == "phone":
        can = can & text.rlike(r"\+[0-9]")
    return F.when(can, F.filter(_pieces(text, pattern), lambda s: CHECKS[kind](s["value"]))).otherwise(F.array().cast(_NONE))


def find_base(docs: DataFrame, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, ``text`` (never null), and one array of spans for each base kind."""
    frame = docs.select(*key_cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    return frame.select(*key_cols, F.col("__text"), *[base_spans(F.col("__text"), k).alias(f"__{k}") for k in KINDS])


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in chunks, without a walk from its beginning."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    at = (start - first * CHUNK).cast("int")
    inside = F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), at + 1, (end - start).cast("int"))
    return F.when(end <= start, "").otherwise(inside)


def _apart(spans: Column, taken: Column, margin: int) -> Column:
    """For each of ``spans`` (sorted, none over another) whether it is more than ``margin`` away from all of ``taken``, which may overlap."""
    kind = "array<struct<start:bigint,mine:boolean,end:bigint>>"
    theirs = F.transform(taken, lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("mine"), s["end"].alias("end"))).cast(kind)
    mine = F.transform(spans, lambda s: F.struct((s["start"] - margin).alias("start"), F.lit(True).alias("mine"), (s["end"] + margin).alias("end"))).cast(kind)

    def before(top: Column, x: Column) -> Column:  # up to here, where does what is taken end?
        return F.struct(F.when(x["mine"], top).otherwise(F.greatest(top, x["end"])).alias("state"), F.when(x["mine"], top <= x["start"]).alias("out"))

    def after(least: Column, x: Column) -> Column:  # from here on, where does what is taken begin?
        return F.struct(F.when(x["mine"], least).otherwise(x["start"]).alias("state"), F.when(x["mine"], least >= x["end"]).alias("out"))

    def known(flags: Column) -> Column:
        return F.filter(flags, lambda f: f.isNotNull())

    def both(order: Column) -> Column:
        one = known(_fold(order, F.lit(-(1 << 62)).cast("long"), before, "boolean"))
        two = known(_fold(F.reverse(order), F.lit(1 << 62).cast("long"), after, "boolean"))
        return F.zip_with(one, F.reverse(two), lambda x, y: x & y)

    return F.when(F.size(taken) == 0, F.transform(spans, lambda s: F.lit(True))).otherwise(_let(F.array_sort(F.concat(theirs, mine)), both))


def _fresh(text: Column, kind: str, pattern: str, base: Column, taken: Column, none: Column) -> Column:
    """Candidates of one kind that touch neither base spans nor earlier candidates, with up to 24 characters on either side."""

    def free(spans: Column) -> Column:
        marked = F.arrays_zip(spans.alias("s"), _apart(spans, F.concat(base, taken), 0).alias("good"))
        return F.transform(F.filter(marked, lambda z: z["good"]), lambda z: z["s"])

    def named(spans: Column) -> Column:
        def one(chunks: Column, z: Column) -> Column:
            s = z["s"]
            before = _cut(chunks, F.greatest(s["start"] - 24, F.lit(0).cast("long")), s["start"])
            after = _cut(chunks, s["end"], s["end"] + 24)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), before.alias("before"), after.alias("after"), (~z["lone"]).alias("near"))

        zipped = F.arrays_zip(spans.alias("s"), _apart(spans, base, NEAR).alias("lone"))
        return F.when(F.size(spans) == 0, none).otherwise(_let(_chunks(text), lambda chunks: F.transform(zipped, lambda z: one(chunks, z))))

    return _let(_pieces(text, pattern), lambda spans: F.when(F.size(spans) == 0, none).otherwise(_let(free(spans), named)))


def _labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda c: c["kind"] == kind)


def _marked(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def with_candidates(found: DataFrame) -> DataFrame:
    """Add ``__candidates``: wider spans that touch no base span, earlier kinds first, none over another."""
    text = F.col("__text")
    places = "array<struct<start:bigint,end:bigint>>"
    found = found.withColumn("__base", F.concat(*[F.transform(f"__{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(places) for k in KINDS]))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string,near:boolean>>")
    names: list[str] = []
    for kind, pattern in WIDER.items():  # one column after the other, so that none is computed twice
        taken = F.transform(F.concat(*names), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(places) if names else F.array().cast(places)
        found = found.withColumn(f"__w_{kind}", F.when(text.rlike(WIDER_NEEDS[kind]), _fresh(text, kind, pattern, F.col("__base"), taken, none)).otherwise(none))
        names.append(f"__w_{kind}")
    return found.withColumn("__candidates", F.concat(*names))


def votes(c: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate struct: 1 personal, -1 not, 0 abstain."""
    value, kind, before, after = c["value"], c["kind"], c["before"], c["after"]
    part = F.regexp_replace(value, r"^[A-Za-z_-]+\s*[=:]\s*[\"']?", "")  # without the name of what it is
    digits = F.length(_digits(part))
    letters = F.length(F.regexp_replace(part, "[^A-Za-z]", ""))
    repeated = value.rlike(r"([0-9A-Za-z])\1{5}")
    return {
        "shape": F.when(value.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|[=:]\s*[\"']?[0-9a-fA-F]{12,}|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|[(\[{]at[)\]}]|^\([0-9]{3}\)"), 1).when(repeated, -1).otherwise(0),
        "structure": F.when((kind == "secret") & (digits >= 2) & (letters >= 2) | (kind == "local_phone") & (digits == 10) | (kind == "id_number") & (digits == 9) & value.contains("-"), 1)
        .when((kind == "id_number") & ~value.rlike(r"[\x20-]"), -1)
        .when((kind == "hidden_email") & value.rlike(r"(?i)\x20at\x20") & ~value.rlike(r"(?i)\x20dot\x20"), -1)
        .otherwise(0),
        "gazetteer": F.when(value.rlike(EXAMPLES), -1).when(value.rlike(r"(?i)^(?:password|passwd|pwd|secret|token|api|access)|^(?:AKIA|ASIA)"), 1).otherwise(0),
        "context": F.when(before.rlike(CONTEXT), 1).otherwise(0),
        "anti_context": F.when(before.rlike(ANTI_CONTEXT) | after.rlike(AFTER), -1).otherwise(0),
        "sentence": F.when(value.rlike(r"[.]\x20[A-Z]") | before.rlike(SENTENCE) & ~value.rlike(r"[=:({\[]"), -1).otherwise(0),
        "neighbours": F.when(c["near"], 1).otherwise(0),
        "randomness": F.when((kind == "secret") & (digits >= 2) & (F.size(F.array_distinct(F.split(F.lower(part), ""))) >= 8), 1).when((kind == "secret") & part.rlike("^[A-Za-z]{1,12}[\"']?$") | (F.size(F.array_distinct(F.split(value, ""))) <= 3), -1).otherwise(0),
    }


def em(patterns: dict[tuple[int, ...], int], prior: float = 0.5, rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Dawid-Skene for two classes over vote patterns and their counts.

    Returns the class share, for every labeler the probability of each vote given (personal, not), and every pattern's posterior.
    """
    n_labelers = len(next(iter(patterns), ()))
    posterior = {p: min(0.95, max(0.05, 0.5 + 0.2 * sum(p))) for p in patterns}
    share, tables = prior, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in range(n_labelers)]
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        share = (sum(posterior[p] * n for p, n in patterns.items()) + 1) / (total + 2)
        for j in range(n_labelers):
            # a weak prior that votes are better than chance keeps the classes from trading places
            counts = {v: [0.5 + 0.5 * (v == 1), 0.5 + 0.5 * (v == -1)] for v in (-1, 0, 1)}
            for p, n in patterns.items():
                counts[p[j]][0] += posterior[p] * n
                counts[p[j]][1] += (1 - posterior[p]) * n
            sums = [sum(c[k] for c in counts.values()) for k in (0, 1)]
            tables[j] = {v: (c[0] / sums[0], c[1] / sums[1]) for v, c in counts.items()}
        for p in patterns:
            a = math.log(share) + sum(math.log(tables[j][v][0]) for j, v in enumerate(p))
            b = math.log(1 - share) + sum(math.log(tables[j][v][1]) for j, v in enumerate(p))
            posterior[p] = 1 / (1 + math.exp(min(700, max(-700, b - a))))
    return share, tables, posterior


def features(c: Column) -> dict[str, Column]:
    """Binary features of the final classifier."""
    own = {f"kind_{k}": c["kind"] == k for k in WIDER}
    for name, vote in votes(c).items():
        own[f"{name}_for"] = vote == 1
        own[f"{name}_against"] = vote == -1
    own["long"] = F.length(c["value"]) >= 20
    return own


def fit_logistic(rows: list[tuple[tuple[int, ...], float, float]], n: int, steps: int = 400, ridge: float = 1e-3) -> tuple[float, list[float]]:
    """Weights from (features, soft label, count) by gradient steps over the few distinct rows."""
    bias, weights = 0.0, [0.0] * n
    total = sum(c for _, _, c in rows) or 1
    for _ in range(steps):
        gb, gw = 0.0, [ridge * w for w in weights]
        for x, y, c in rows:
            z = bias + sum(weights[i] for i, v in enumerate(x) if v)
            d = (1 / (1 + math.exp(-max(-500, min(500, z)))) - y) * c / total
            gb += d
            for i, v in enumerate(x):
                if v:
                    gw[i] += d
        bias -= 2 * gb
        weights = [w - 2 * g for w, g in zip(weights, gw, strict=True)]
    return bias, weights


class SpanModel:
    """Labeler reliabilities and the final classifier.

    ``tables``: for every labeler the probability of each vote given (personal, not), as ``em`` estimates them.
    """

    def __init__(self, bias: float, weights: dict[str, float], share: float = 0.5, tables: list | None = None):
        self.bias, self.weights, self.share, self.tables = bias, weights, share, tables or []

    def reliabilities(self) -> dict[str, tuple[float, float]]:
        """For every labeler how often it votes, and how often rightly where it votes, by its own estimates."""
        out = {}
        for name, table in zip(LABELERS, self.tables, strict=True) if self.tables else ():
            right, wrong = self.share * table[1][0] + (1 - self.share) * table[-1][1], self.share * table[-1][0] + (1 - self.share) * table[1][1]
            out[name] = (right + wrong, right / (right + wrong))
        return out

    def accepts(self, c: Column, threshold: float = THRESHOLD) -> Column:
        own = features(c)
        terms = [F.when(own[k], F.lit(w)).otherwise(F.lit(0.0)) for k, w in self.weights.items() if abs(w) > 1e-9]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.bias))) > math.log(threshold / (1 - threshold))


def train(found: DataFrame) -> SpanModel:
    """Fit on what ``search`` found; only counts of feature patterns reach the driver."""
    c = F.col("c")
    spans = found.select(F.explode("__candidates").alias("c"))
    own, voted = features(c), votes(c)
    names = list(own)
    flat = spans.select(*[F.coalesce(v, F.lit(0)).cast("int").alias(f"v_{k}") for k, v in voted.items()], *[F.coalesce(own[k], F.lit(False)).cast("int").alias(f"f_{k}") for k in names])
    counted = flat.groupBy(*flat.columns).count().collect()
    if not counted:
        return SpanModel(-10.0, dict.fromkeys(names, 0.0))
    patterns: dict[tuple[int, ...], int] = {}
    for r in counted:
        key = tuple(r[f"v_{k}"] for k in LABELERS)
        patterns[key] = patterns.get(key, 0) + r["count"]
    share, tables, posterior = em(patterns)
    rows = [(tuple(r[f"f_{k}"] for k in names), posterior[tuple(r[f"v_{k}"] for k in LABELERS)], float(r["count"])) for r in counted]
    bias, weights = fit_logistic(sorted(rows), len(names))
    return SpanModel(bias, dict(zip(names, weights, strict=True)), share, tables)


def search(docs: DataFrame, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",), keep_text: bool = True) -> DataFrame:
    """Key columns, ``__text`` (if kept), base spans and ``__candidates``, written to the shared folder: the search is the work, and all else reads its few rows."""
    found = with_candidates(find_base(docs, text_col, key_cols))
    return staged(found.select(*key_cols, *[F.col("__text")] * keep_text, *[F.col(f"__{k}") for k in KINDS], "__candidates"), "pii")


def find(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",), keep_text: bool = True) -> DataFrame:
    """Key columns, ``text`` (if kept), the base spans by kind (``email`` ... arrays of start, end, value) and ``added`` (kind, start, end, value, before, after, near)."""
    found = search(docs, text_col, key_cols, keep_text)
    model = model or train(found)
    added = F.filter("__candidates", lambda c: model.accepts(c))
    return found.select(*key_cols, *[F.col("__text").alias("text")] * keep_text, *[F.col(f"__{k}").alias(k) for k in KINDS], added.alias("added"))


def joined_spans(kinds: dict[str, Column]) -> Column:
    """``kind:start:end`` by kind as given, then start, comma-joined."""
    return F.array_join(F.concat(*[_labelled(spans, kind) for kind, spans in kinds.items()]), ",")


def span_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans, and all spans."""
    base = {k: F.col(k) for k in KINDS}
    more = {k: _of_kind("added", k) for k in WIDER}
    return found.select(
        key, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(base | more).alias("spans")
    )


def redact(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with every span of the text replaced by its kind in angle brackets; null texts stay null."""
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    at = names[columns.index(text_col)]
    plain = docs.toDF(*names)
    found = find(plain, model, at, tuple(names))
    every = F.concat(*[_marked(k, k) for k in KINDS], F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("text")

    def step(chunks: Column, at: Column, s: Column) -> Column:
        # a span inside what is already replaced adds nothing
        mark = F.when(s["start"] >= at, F.concat(_cut(chunks, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(at, s["end"]).alias("state"), mark.alias("out"))

    # an empty span at the end brings the rest of the text
    ordered = F.concat(F.array_sort(every), F.array(F.struct(F.length(text).cast("long").alias("start"), F.length(text).cast("long").alias("end"), F.lit("").alias("kind"))))
    pieces = _let(_chunks(text), lambda chunks: _let(ordered, lambda spans: _fold(spans, F.lit(0).cast("long"), lambda at, s: step(chunks, at, s), "string")))
    replaced = F.regexp_replace(F.array_join(pieces, ""), "<>$", "")
    clean = F.when(F.col(at).isNull(), F.lit(None).cast("string")).when(F.size(every) == 0, text).otherwise(replaced)
    return found.select(*[clean.alias(c) if n == at else F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])
