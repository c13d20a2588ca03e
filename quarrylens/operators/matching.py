"""Joins on parts of names and paths, and membership in arrays, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def under_roots(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Paths with the longest root folder that holds them, or null: each path's folders meet the roots by equality."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    r = roots.select(F.col(root).alias("__r")).distinct()
    hits = paths.select(F.col(path).alias("__p"), F.explode(F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>"))).alias("__f")).join(r, F.col("__f") == F.col("__r"))
    best = hits.groupBy("__p").agg(F.max_by("__r", F.length("__r")).alias(root))
    return paths.join(best, F.col(path) == F.col("__p"), "left").drop("__p")


def unique_suffix(queries: DataFrame, paths: DataFrame, query: str, path: str) -> DataFrame:
    """Queries that end in exactly one known path, with that path; blocked on the last segment."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    p = paths.select(F.col(path).alias("match")).distinct().withColumn("__l", last(F.col("match")))
    hits = queries.withColumn("__q", last(F.col(query))).join(p, (F.col("__q") == F.col("__l")) & (F.col(query) == F.col("match")) | (F.col("__q") == F.col("__l")) & F.col(query).endswith(F.concat(F.lit("/"), F.col("match"))))
    found = hits.groupBy(query).agg(F.count(F.lit(1)).alias("__c"), F.min("match").alias("match")).where("__c = 1")
    return found.select(query, "match")


def member(values: Column, wanted: str) -> Column:
    """Exact membership without regard to case."""
    return F.exists(values, lambda v: F.lower(v) == wanted.lower())


#: Ends of type names that mean the object's data (fixed values).
DATA_SUFFIXES = ("Object", "RecordSet", "Manager", "ValueManager")


def type_of_object(types: Column, kind: str, name: str) -> Column:
    """Whether an array of types holds a data type of the object, by the closed list of suffixes."""
    pattern = rf"(?i)^{kind}(?:{'|'.join(DATA_SUFFIXES)})\.{name}$"
    return F.exists(types, lambda t: t.rlike(pattern))


def via(direct: Column, defined: Column, whole_kind: Column) -> Column:
    """How a subscription reaches an object: directly, through a defined type, or with its whole kind."""
    return F.when(direct, "direct").when(defined, "defined_type").when(whole_kind, "whole_kind")


def through_types(subscriptions: DataFrame, defined: DataFrame) -> DataFrame:
    """(name, type): subscriptions (name, sources) with the types they name, defined types (type_name, refs) unfolded."""
    named = subscriptions.select("name", F.explode("sources").alias("type"))
    unfolded = named.join(defined.select(F.col("type_name").alias("type"), F.explode("refs").alias("ref")), "type").select("name", F.col("ref").alias("type"))
    return named.unionByName(unfolded).distinct()


def similar_by_prefix(names: DataFrame, name: str, query: str, least: int = 4, n: int = 3) -> DataFrame:
    """The n names with the longest common prefix (100 more if one holds the other), ``least`` or more."""
    low, q = F.lower("name"), query.lower()
    steps = F.sequence(F.lit(1), F.lit(len(q)))
    common = F.aggregate(steps, F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substring(low, i, F.lit(1)) == F.substring(F.lit(q), i, F.lit(1))), i).otherwise(s))
    score = common + F.when(F.contains(low, F.lit(q)) | F.contains(F.lit(q), low), 100).otherwise(0)
    return names.select(F.col(name).alias("name")).distinct().withColumn("similarity", score.cast("long")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "name").limit(n)


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows that only one of two answers has."""
    one = a.exceptAll(b).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only_a").alias("side"), "n")
    return one.unionByName(b.exceptAll(a).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only_b").alias("side"), "n"))


def snippets(docs: DataFrame, id_col: str, text_col: str, term: str, around: int = 30) -> DataFrame:
    """(id, snippet): the first match with what stands around it, marked."""
    at = F.locate(term.lower(), F.lower(text_col))
    cut = F.concat(F.substring(text_col, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around))), F.lit("["), F.substring(text_col, at, F.lit(len(term))), F.lit("]"), F.substring(text_col, at + len(term), F.lit(around)))
    return docs.withColumn("__at", at).where("__at > 0").select(F.col(id_col).alias("id"), F.regexp_replace(cut, r"\s+", " ").alias("snippet"))


def penalized(found: DataFrame, context: str, symbol: str, score: str) -> DataFrame:
    """Scores divided by how common their context and symbol are among the findings."""
    n_ctx = F.count(F.lit(1)).over(Window.partitionBy(context))
    n_sym = F.count(F.lit(1)).over(Window.partitionBy(symbol))
    return found.withColumn("penalized", F.col(score) / (1 + F.log(n_ctx.cast("double"))) / (1 + F.log(n_sym.cast("double"))))
