"""Questions about one indexed project, each answered by a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph, matching, relational, resolve, search, vectors
from .plans import sqlguard
from .sources.snapshot import Store


class Project:
    """A snapshot store with the tables that ``plans.build`` writes."""

    def __init__(self, spark: SparkSession, index: str):
        self.spark, self.store = spark, Store(spark, index)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def edges(self) -> DataFrame:
        return self.table("calls").where("callee_key IS NOT NULL").select(F.col("caller_key").alias("src"), F.col("callee_key").alias("dst"))

    def query_vector(self, tokens: list[str]) -> list[float]:
        """The idf-weighted sum of a query's token vectors; unknown tokens weigh 1."""
        rows = self.table("semantic_tokens").where(F.col("token").isin(tokens)).collect()  # a row for each word of the query at most
        idf = {r["token"]: r["idf"] for r in rows}
        total = sum((idf.get(t, 1.0) * vectors.random_index(t) for t in tokens), np.zeros(vectors.DIM))
        return vectors.quantize(total).astype(float).tolist()

    def candidates(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        """Names that hold the query or one of its words, those nearest to its vector, and those that hold its words as parts, with the seven signals.

        The last two give three times the limit (30 to 300); vectors are left out where one kind is to be listed at length.
        """
        tokens = [r[0] for r in self.spark.range(1).select(F.explode(T.tokenize_name(F.lit(query)))).collect()]
        idf = search.query_idf(self.table("semantic_tokens"), tokens).first()[0] if tokens else 1.0
        wide = min(max(3 * limit, 30), 300)
        named = self.store.kept("semantic_vectors")
        near = T.has(F.col("name"), query) | (F.size(F.array_intersect(T.tokenize_name(F.col("name")), F.array(*map(F.lit, tokens)).cast("array<string>"))) > 0)
        calls = self.edges().groupBy(F.col("dst").alias("__k")).agg(F.count(F.lit(1)).alias("degree"))
        called = self.table("methods").join(calls, F.col("method_key") == F.col("__k")).select(F.col("id").alias("__id"), "degree")
        zero = F.lit(0.0)

        def signals(rows: DataFrame, **own) -> DataFrame:
            values = {"exact": T.name_precision(F.col("name"), query), "synonym": F.coalesce(T.name_precision(F.col("synonym"), query), zero), "bm25": zero, "semantic": zero, "idf": zero, "usage": zero, "degree": zero} | own
            return rows.select("kind", "name", F.col("place").alias("payload"), *[c.cast("double").alias(n) for n, c in values.items()])

        degree = F.log1p(F.coalesce("degree", F.lit(0)))
        found = signals(named.where(near).join(called, F.col("id") == F.col("__id"), "left"), idf=F.lit(float(idf)), usage=degree, degree=degree)
        if tokens and not (kind is not None and limit > 25):
            q, v = F.array(*map(F.lit, self.query_vector(tokens))), F.col("vector")
            score = F.when(vectors.dot(v, v) > 0, vectors.dot(v, q) / F.sqrt(vectors.dot(v, v)) / F.sqrt(vectors.dot(q, q))).otherwise(0.0)
            best = named.withColumn("__s", score).orderBy(F.desc("__s"), "kind", "name", "place").limit(wide)
            found = found.unionByName(signals(best, semantic=F.col("__s")))
        text = F.concat_ws(" ", "name", "synonym")
        parts = search.substring_bm25(named, text, query.split()).orderBy(F.desc("bm25"), "kind", "name", "place").limit(wide)
        return found.unionByName(signals(parts, bm25=F.col("bm25")))

    def find(self, query: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """Ranked names: merged by (kind, name), fused, cut off, exact names first."""
        n = relational.clamp(limit, 20, 500)
        found = self.candidates(query, kind, n)
        found = found if kind is None else found.where(F.col("kind") == kind)
        ranked = search.cut_off(search.fuse(relational.collapse_namesakes(found, list(search.WEIGHTS))))
        return ranked.orderBy(F.desc("score"), F.octet_length("name"), "name").select("kind", "name", F.col("payload").alias("place"), F.round("score", 3).alias("score"), "reason", "others").limit(n)

    def object_card(self, name: str) -> dict[str, DataFrame]:
        """Sections of an object; ``similar`` names it where the object is unknown."""
        own = self.table("object_attributes").where(T.same(F.col("object_name"), name))
        full = F.concat(F.col("category"), F.lit("."), F.col("object_name"))
        return {
            "attributes": own,
            "rights": self.table("role_rights").join(own.select(full.alias("__f")).distinct(), (F.col("object_name") == F.col("__f")) | F.col("object_name").startswith(F.concat(F.col("__f"), F.lit("."))), "left_semi"),
            "predefined": self.table("predefined_items").where(T.same(F.col("owner"), name)),
            "used_by": self.table("metadata_references").join(own.select(full.alias("__f")).distinct(), F.col("ref_object") == F.col("__f"), "left_semi"),
            "subscriptions": self.table("event_subscriptions").where(F.exists("sources", lambda s: F.lower(s).endswith(f".{name.lower()}"))),
            "similar": search.similar_names(self.table("object_attributes"), "object_name", name),
        }

    def method_keys(self, method: str, module: str | None = None) -> DataFrame:
        found = self.table("methods").where(T.same(F.col("name"), method))
        return (found if module is None else found.where(F.lower("rel_path").endswith(module.lower()))).select("method_key")

    def callers(self, method: str, module: str | None = None, direction: str = "in", depth: int = 2, limit: int | None = None) -> DataFrame:
        """Methods that reach the method, or that it reaches, with hop and origin."""
        reached = graph.walk(self.method_keys(method, module), self.edges(), relational.clamp(depth, 2, 5), direction == "in")
        named = reached.join(self.table("methods").select("method_key", "name", "rel_path", "line"), F.col("node") == F.col("method_key"), "left")
        return named.orderBy("hop", "rel_path", "line", "node").select("node", "name", "rel_path", "line", "hop", "via").limit(relational.clamp(limit, 100, 2000))

    def impact(self, method: str) -> DataFrame:
        n = graph.walk(self.method_keys(method), self.edges(), 2).agg(F.count(F.lit(1)).alias("callers"))
        return n.withColumn("risk", graph.impact(F.col("callers")))

    def changed_radius(self, files: DataFrame, direction: str = "inbound", depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """(rows, summary over the full radius) of methods reached from the changed files (path)."""
        seeds = self.table("methods").join(files.select(F.col("path").alias("__p")), F.col("rel_path") == F.col("__p"), "left_semi").select("method_key")
        reached = graph.walk(seeds, self.edges(), depth, direction == "inbound")
        return reached.withColumn("risk", graph.risk_of(F.col("hop"))), graph.risk_summary(reached)

    def outline(self, module: str) -> DataFrame:
        """Methods of a module with their innermost region."""
        m = self.table("methods").where(F.lower("rel_path").endswith(module.lower())).select("id", "rel_path", "name", "type", "is_export", "params", "line", "end_line", "loc")
        r = self.table("regions").select("rel_path", F.col("line").alias("start"), F.col("end_line").alias("end"), F.col("name").alias("region"))
        return relational.innermost_interval(m, r, "rel_path", "line", "id", "region").orderBy("rel_path", "line")

    def overrides(self) -> DataFrame:
        """Methods that replace others, with the line they mean."""
        own = self.table("methods").where("override_of IS NOT NULL").select("id", F.col("rel_path").alias("module"), F.col("override_of").alias("method"), "name")
        return relational.resolve_override(own, self.table("methods").select(F.col("rel_path").alias("module"), "name", "line"))

    def coverage(self) -> DataFrame:
        return resolve.coverage(self.table("calls"))

    def lint(self, least: int = 1) -> DataFrame:
        """Calls of a common module's method that does not exist or takes fewer arguments."""
        params = F.when(F.col("params") == "", 0).otherwise(F.size(F.split("params", ",")))
        bounds = self.table("methods").select(F.col("method_key").alias("__k"), params.alias("most"))
        calls = self.table("calls").join(bounds, F.col("callee_key") == F.col("__k"), "left")
        issue = F.when((F.col("resolution") == "common_module") & F.col("callee_key").isNull(), "unknown_method").when(F.col("arg_count") > F.col("most"), "too_many_arguments")
        return calls.withColumn("issue", issue).where("issue IS NOT NULL").select("rel_path", "line", "callee_name", "issue")

    def similar_methods(self, name: str) -> DataFrame:
        return matching.similar_by_prefix(self.table("methods"), "name", name)

    def sql(self, query: str, limit: int = 200) -> DataFrame:
        self.store.register()
        return sqlguard.run(self.spark, query, limit)


def across(projects: dict[str, Project], question) -> dict[str, DataFrame | Exception]:
    """One question to several projects: an answer or an error for each."""
    out: dict[str, DataFrame | Exception] = {}
    for name, project in projects.items():
        try:
            out[name] = question(project)
        except Exception as e:  # one project's trouble is its own answer
            out[name] = e
    return out
