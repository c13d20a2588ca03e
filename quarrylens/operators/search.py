"""Retrieval: document frequencies, BM25, trigram similarity, vectors, rank fusion, text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .stage import dealt

K1, B = 1.2, 0.75
#: Weights of the seven signals (fixed values).
WEIGHTS = {"exact": 0.40, "synonym": 0.15, "bm25": 0.15, "semantic": 0.13, "idf": 0.07, "usage": 0.06, "degree": 0.04}


def words(text: Column, min_length: int = 1) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= min_length)


def postings(docs: DataFrame, id_col: str, columns: list[str], min_length: int = 1) -> DataFrame:
    """(id, field, term, tf)."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns]))
    rows = docs.select(F.col(id_col).alias("id"), fields.alias("f")).select("id", "f.field", F.explode(words(F.col("f.text"), min_length)).alias("term"))
    return rows.groupBy("id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def token_idf(tokens: DataFrame, entity: str, token: str) -> DataFrame:
    """(token, df, idf) with the smoothed idf ln((n + 1) / (df + 1))."""
    tokens = dealt(tokens.select(entity, token), entity)
    df = tokens.groupBy(F.col(token).alias("token")).agg(F.count_distinct(entity).alias("df"))
    n = tokens.agg(F.count_distinct(entity).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def query_idf(idf: DataFrame, tokens: list[str]) -> DataFrame:
    """The mean idf of a query's tokens; an unknown token counts 1."""
    spark = idf.sparkSession
    q = spark.createDataFrame([(t,) for t in tokens], "q string")
    return q.join(idf, F.col("q") == F.col("token"), "left").agg(F.avg(F.coalesce("idf", F.lit(1.0))).alias("idf"))


def bm25(docs: DataFrame, id_col: str, weights: dict[str, float], terms: list[str], least: int = 1) -> DataFrame:
    """(id, score, matched): Okapi BM25 summed over weighted columns, for documents with ``least`` of the terms or more.

    Texts are tokenized once; lengths and frequencies of the query's terms alone are kept, so the shuffle carries one row a document and field.
    """
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text"), F.lit(float(w)).alias("weight")) for c, w in weights.items() if w]))
    rows = docs.select(F.col(id_col).alias("id"), fields.alias("f")).select("id", "f.field", "f.weight", words(F.col("f.text")).alias("w"))
    rows = rows.select("id", "field", "weight", F.size("w").alias("len"), *[F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])
    held = [F.when(F.col(f"tf{i}") > 0, F.col("id")) for i in range(len(wanted))]
    stats = rows.groupBy("field").agg(F.avg("len").alias("avg_len"), F.count(F.lit(1)).alias("n"), *[F.count(h).alias(f"df{i}") for i, h in enumerate(held)])
    joined = rows.join(F.broadcast(stats), "field")
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    matched = sum(((F.max(f"tf{i}") > 0).cast("int") for i in range(len(wanted))), F.lit(0))
    return joined.groupBy("id").agg(F.sum(F.col("weight") * score).alias("score"), matched.cast("long").alias("matched")).where(F.col("matched") >= least)


def substring_bm25(docs: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """``docs`` that hold all terms as parts of ``text``, with ``bm25``: each term counts as one phrase of trigrams, of which a text has two fewer than letters.

    Terms of fewer than three letters have no trigram and match nothing.  Corpus statistics are one aggregate row.
    """
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    low = F.lower(text)
    tf = [((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("double") for t in wanted]
    size = F.greatest(F.length(low) - 2, F.lit(0)).cast("double")
    stats = docs.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg(size).alias("__avg"), *[F.count_if(f > 0).cast("double").alias(f"__df{i}") for i, f in enumerate(tf)])
    if not wanted or any(len(t) < 3 for t in wanted):
        return docs.where(F.lit(False)).withColumn("bm25", F.lit(0.0))
    held = docs
    for f in tf:
        held = held.where(f > 0)
    score = F.lit(0.0)
    for i, f in enumerate(tf):
        df = F.col(f"__df{i}")
        score = score + F.greatest(F.log((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.col("__avg")))
    return held.crossJoin(F.broadcast(stats)).withColumn("bm25", score).drop("__n", "__avg", *[f"__df{i}" for i in range(len(wanted))])


def _equals(term: str):
    return lambda w: w == term


def and_then_or(docs: DataFrame, id_col: str, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """Documents with all terms; if there are none, those with any."""
    found = bm25(docs, id_col, weights, terms, 1)
    n = len(dict.fromkeys(t.lower() for t in terms))
    most = found.agg(F.max("matched").alias("__most"))  # one row
    return found.crossJoin(F.broadcast(most)).where((F.col("__most") < n) | (F.col("matched") == n)).drop("__most")


def similar_names(names: DataFrame, column: str, query: str, least: float = 0.3, n: int = 5) -> DataFrame:
    """The n names that share most trigrams with the query: common over the larger set."""
    grams = F.array(*[F.lit(g) for g in dict.fromkeys(query.lower()[i : i + 3] for i in range(max(0, len(query) - 2)))]).cast("array<string>")
    scored = names.select(F.col(column).alias("name")).distinct().withColumn("similarity", F.round(T.overlap(T.ngrams(F.col("name")), grams), 6))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "name").limit(n)


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped from -1..1 to 0..1, 0 where a vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    nb = F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot / F.sqrt(na * nb) + 1) / 2)))


def normalize_signals(candidates: DataFrame, signals: list[str], degenerate: float = 0.0) -> DataFrame:
    """Each signal scaled to 0..1 over all candidates; a signal equal for all becomes ``degenerate``.

    Ranges are one aggregate row, broadcast: candidates never meet in one task.
    """
    ranges = candidates.agg(*[F.min(s).alias(f"__lo_{s}") for s in signals], *[F.max(s).alias(f"__hi_{s}") for s in signals])
    out = candidates.crossJoin(F.broadcast(ranges))
    for s in signals:
        lo, hi = F.col(f"__lo_{s}"), F.col(f"__hi_{s}")
        out = out.withColumn(s, F.when(hi > lo, (F.col(s) - lo) / (hi - lo)).otherwise(F.lit(degenerate)))
    return out.drop(*[f"__lo_{s}" for s in signals], *[f"__hi_{s}" for s in signals])


def fuse(candidates: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds score, the weighted sum of normalised signals, and reason, the last signal in declared order with the largest part."""
    out = normalize_signals(candidates, list(weights))
    parts = [(F.col(s) * w).alias(s) for s, w in weights.items()]
    out = out.withColumn("score", sum((F.col(s) * w for s, w in weights.items()), F.lit(0.0)))
    top = F.greatest(*[p for p in parts])
    reason = F.lit(None).cast("string")
    for s, w in weights.items():
        reason = F.when(F.col(s) * w >= top, F.lit(s)).otherwise(reason)
    return out.withColumn("reason", reason)


def cut_off(ranked: DataFrame, bound: float = 0.25, least: int = 3) -> DataFrame:
    """Rows with the bound's score or more, and never fewer than ``least`` rows."""
    strong = ranked.agg(F.count_if(F.col("score") >= bound).alias("__strong"))
    top = ranked.orderBy(F.desc("score"), F.octet_length("name"), "name").limit(least).select(F.col("kind").alias("__k"), F.col("name").alias("__n"))
    strongs = ranked.where(F.col("score") >= bound)
    weak = ranked.where(F.col("score") < bound).join(F.broadcast(top), (F.col("kind") == F.col("__k")) & (F.col("name") == F.col("__n")), "left_semi")
    return strongs.unionByName(weak.crossJoin(F.broadcast(strong)).where(F.col("__strong") < least).drop("__strong"))


def grep(docs: DataFrame, id_col: str, text_col: str, pattern: str, regex: bool = False, case_sensitive: bool = False, cut: int = 200) -> DataFrame:
    """(id, line, text) of every line that matches; lines are trimmed and cut."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    if regex:
        hit = F.col("raw").rlike(pattern if case_sensitive else f"(?iu){pattern}")
    else:
        hit = F.contains(F.col("raw"), F.lit(pattern)) if case_sensitive else T.has(F.col("raw"), pattern)
    shown = F.trim("raw")
    return lines.where(hit).select("id", (F.col("pos") + 1).cast("long").alias("line"), F.when(F.length(shown) > cut, F.concat(F.left(shown, F.lit(cut)), F.lit("…"))).otherwise(shown).alias("text"))


def relevance_order(name: Column, synonym: Column, query: str) -> list[Column]:
    """Order before a limit: the name itself, the synonym itself, a name and then a synonym that begins so, short names first."""
    q = query.lower()
    low, other = F.lower(name), F.coalesce(F.lower(synonym), F.lit(""))
    return [F.desc(low == q), F.desc(other == q), F.desc(F.startswith(low, F.lit(q))), F.desc(F.startswith(other, F.lit(q))), F.length(name).asc()]


def suggest(entries: DataFrame, title: str, owner: str, terms: list[str], exact: str, wanted_owner: str | None = None, stem: int = 5) -> DataFrame:
    """``entries`` that hold two stems of the terms or whose title is ``exact``, with ``rank_score``.

    Exact title 10,000, the wanted owner 2,000, each matched stem 100, each stem in the title 50, less the title's length.
    """
    stems = list(dict.fromkeys(t.lower()[:stem] for t in terms))
    head = F.lower(title)
    whole = F.concat_ws(" ", head, F.lower(owner))
    matched = sum((F.contains(whole, F.lit(t)).cast("int") for t in stems), F.lit(0))
    titled = sum((F.contains(head, F.lit(t)).cast("int") for t in stems), F.lit(0))
    same = (head == exact.lower()).cast("int")
    owned = (F.lower(owner) == wanted_owner.lower()).cast("int") if wanted_owner else F.lit(0)
    score = same * 10_000 + owned * 2000 + matched * 100 + titled * 50 - F.length(title)
    return entries.where((matched >= 2) | (same == 1)).withColumn("rank_score", score.cast("long"))
