"""More operators on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, mining, relational, search
from ..sources import metadata, modules
from . import catalogue
from .registry import query

PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _paths(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query("WITH p AS (SELECT DISTINCT " + PATH_SQL + " AS path FROM pages), r AS (SELECT DISTINCT array_to_string(string_split(path, '/')[:-2], '/') AS root FROM p WHERE contains(path, '/en/')) SELECT path, (SELECT arg_max(root, length(root)) FROM r WHERE starts_with(path, root || '/')) AS root FROM p")
def prefix_join(t):
    p = _paths(t).select("path").distinct()
    parts = F.split("path", "/")
    roots = p.where(F.contains("path", F.lit("/en/"))).select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("root"))
    return matching.under_roots(p, roots, "path", "root")


@query("WITH p AS (SELECT DISTINCT 'dump/' || " + PATH_SQL + " AS q FROM pages), k AS (SELECT DISTINCT string_split(" + PATH_SQL + ", '/')[-1] AS m FROM pages UNION SELECT DISTINCT array_to_string(string_split(" + PATH_SQL + ", '/')[-2:], '/') FROM pages WHERE contains(url, '/en/')), h AS (SELECT q, m FROM p JOIN k ON q = m OR ends_with(q, '/' || m)) SELECT q, min(m) AS match FROM h GROUP BY q HAVING count(*) = 1")
def unique_suffix_match(t):
    p, parts = _paths(t), F.split("path", "/")
    known = p.select(F.element_at(parts, -1).alias("m")).unionByName(p.where("contains(path, '/en/')").select(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/").alias("m")))
    return matching.unique_suffix(p.select(F.concat(F.lit("dump/"), F.col("path")).alias("q")).distinct(), known, "q", "m")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'ring')")
def array_membership(t):
    return t.part.where(matching.member(F.split("p_name", " "), "RING")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN 'Object.X' ELSE 'Ref.X' END = 'BUILDINGObject.X'")
def type_suffix_match(t):
    types = F.array(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "Object.X").otherwise("Ref.X")))
    return t.customer.where(matching.type_of_object(types, "Building", "X")).select("c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'direct' WHEN p_size < 5 THEN 'defined_type' WHEN p_size < 20 THEN 'whole_kind' END AS via FROM part")
def via_precedence(t):
    return t.part.select("p_partkey", matching.via(F.col("p_size") == 1, F.col("p_size") < 5, F.col("p_size") < 20).alias("via"))


@query("SELECT n_name AS name, 'R' || n_regionkey AS type FROM nation UNION SELECT nation.n_name, 'Nation.' || m.n_name FROM nation JOIN (SELECT n_name, n_regionkey AS k FROM nation) m ON k = n_regionkey")
def subscriptions_through_types(t):
    subs = t.nation.select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("sources"))
    defined = t.nation.groupBy(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("type_name")).agg(F.collect_list(F.concat(F.lit("Nation."), F.col("n_name"))).alias("refs"))
    return matching.through_types(subs, defined)


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, (SELECT count(*) FROM range(1, 11) r(i) WHERE left(lower(name), i::INT) = left('small ring', i::INT) AND length(name) >= i) + CASE WHEN contains(lower(name), 'small ring') OR contains('small ring', lower(name)) THEN 100 ELSE 0 END AS similarity FROM n) SELECT name, similarity FROM s WHERE similarity >= 4 ORDER BY similarity DESC, name LIMIT 3")
def similar_by_prefix(t):
    return matching.similar_by_prefix(t.part, "p_name", "Small Ring")


@query("SELECT 'only_a' AS side, count(*) AS n FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'only_b', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def answer_comparison(t):
    return matching.compare_sets(t.customer.where("c_acctbal < 0").select("c_custkey"), t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("""WITH a AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents) SELECT doc_id AS id, regexp_replace(substr(text, greatest(p - 30, 1)::INT, least(p - 1, 30)::INT) || '[' || substr(text, p::INT, 7) || ']' || substr(text, (p + 7)::INT, 30), '\\s+', ' ', 'g') AS snippet FROM a WHERE p > 0""")
def search_snippets(t):
    return matching.snippets(t.documents, "doc_id", "text", "License")


@query("WITH f AS (SELECT p_type, p_brand, avg(p_retailprice) AS s FROM part GROUP BY ALL) SELECT p_type, p_brand, round(s / (1 + ln(count(*) OVER (PARTITION BY p_type))) / (1 + ln(count(*) OVER (PARTITION BY p_brand))), 4) AS penalized FROM f")
def context_penalty(t):
    f = t.part.groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("s"))
    return matching.penalized(f, "p_type", "p_brand", "s").select("p_type", "p_brand", F.round("penalized", 4).alias("penalized"))


@query("SELECT doc_id, substr(text, 101, 50) AS slice, length(text) > 150 AS has_more FROM documents")
def text_slice(t):
    return t.documents.select("doc_id", F.substring("text", 101, 50).alias("slice"), (F.length("text") > 150).alias("has_more"))


@query("SELECT n_name, n_name IN ('FRANCE', 'GERMANY') AS known FROM nation WHERE n_regionkey NOT IN (0, 1)")
def kind_whitelist(t):
    return t.nation.where(~F.col("n_regionkey").isin(0, 1)).select("n_name", F.col("n_name").isin("FRANCE", "GERMANY").alias("known"))


@query("SELECT event_id, regexp_replace(regexp_replace(props, '\\p{L}+', 'a', 'g'), '[0-9]+', '0', 'g') AS shape FROM events")
def literal_shapes(t):
    return t.events.select("event_id", T.literal_shape(F.col("props")).alias("shape"))


@query("SELECT page_id, array_to_string(list_filter(string_split(" + PATH_SQL + ", '/'), lambda x: x <> 'en'), ' / ') AS parts, len(list_filter(string_split(" + PATH_SQL + ", '/'), lambda x: x <> 'en'))::BIGINT AS depth FROM pages")
def subsystem_paths(t):
    parts = F.filter(F.split("path", "/"), lambda x: x != "en")
    return _paths(t).select("page_id", F.array_join(parts, " / ").alias("parts"), F.size(parts).cast("long").alias("depth"))


@query("WITH b AS (SELECT conv_id AS basket, role || '/' || (turn % 3)::VARCHAR AS symbol, turn AS pos FROM conversations), w AS (SELECT basket, symbol AS s0, lead(symbol) OVER (PARTITION BY basket ORDER BY pos, symbol) AS s1 FROM b), g AS (SELECT DISTINCT basket, s0 || ' > ' || s1 AS gram FROM w WHERE s1 IS NOT NULL AND s1 <> s0) SELECT gram, count(*) AS baskets FROM g GROUP BY 1 HAVING count(*) >= 5")
def turn_bigrams(t):
    e = t.conversations.select("conv_id", F.concat(F.col("role"), F.lit("/"), (F.col("turn") % 3).cast("string")).alias("symbol"), "turn")
    return mining.sequences(e, "conv_id", "symbol", "turn", 2, 5)


@query("SELECT n_name AS extension, count(s_suppkey) AS overrides, count(DISTINCT s_suppkey % 7) AS objects FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def overrides_by_extension(t):
    s = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("overrides"), F.count_distinct(F.col("s_suppkey") % 7).alias("objects"))
    joined = t.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select(F.col("n_name").alias("extension"), F.coalesce("overrides", F.lit(0)).alias("overrides"), F.coalesce("objects", F.lit(0)).alias("objects"))


@query("WITH m AS (SELECT event_type, user_id, (count(*) OVER (PARTITION BY event_type)) AS total, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) SELECT event_type, user_id, total FROM m WHERE rn = 1")
def first_with_total(t):
    best = t.events.groupBy("event_type").agg(F.min_by("user_id", "event_id").alias("user_id"), F.count(F.lit(1)).alias("total"))
    return best.select("event_type", "user_id", "total")


@query(catalogue.EDGES_SQL + ", w AS (SELECT count(*) AS total FROM edges), d AS (SELECT dst AS node, count(*) AS weight FROM edges GROUP BY 1) SELECT node, weight, total FROM d, w WHERE weight >= 2")
def hubs_with_total(t):
    e = catalogue.edges(t)
    total = e.agg(F.count(F.lit(1)).alias("total"))
    return e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("weight")).where("weight >= 2").crossJoin(F.broadcast(total))


@query("SELECT o_orderkey, array_to_string(list_filter(regexp_extract_all(o_orderpriority || ' FROM Catalog.Goods, Document.Sale.Rows // Catalog.Hidden', '(?:Catalog|Document)\\.[\\w.]+'), lambda x: x <> 'Catalog.Hidden'), ' ') AS refs FROM orders")
def query_sources(t):
    text = F.concat("o_orderpriority", F.lit(" FROM Catalog.Goods, Document.Sale.Rows // Catalog.Hidden"))
    return t.orders.select("o_orderkey", F.array_join(F.transform(metadata.query_sources(text), lambda x: x["object_ref"]), " ").alias("refs"))


@query()
def syntax_metrics(t):
    """Cyclomatic number and nesting of texts, by the lexer: no SQL."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            found = [modules.complexity(x or "") for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "cyclomatic": [a for a, _ in found], "nesting": [b for _, b in found]})

    return t.documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, cyclomatic bigint, nesting bigint")


@query()
def event_extraction(t):
    """Calls with argument counts from module texts, by the lexer: no SQL."""
    body = F.concat(F.lit("Procedure P"), F.col("conv_id").cast("string"), F.lit("(A)\n  Tools.Say("), F.col("turn").cast("string"), F.lit(", A);\nEndProcedure\n"))
    files = t.conversations.select(F.concat(F.lit("m/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("rel_path"), body.alias("content"))
    return modules.parse(files, "calls")


@query("WITH d AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS w FROM part) SELECT id, len(list_intersect(w, ['small', 'ring']))::BIGINT AS hits FROM d WHERE len(list_intersect(list_distinct(w), ['small', 'ring'])) >= 2")
def minimum_terms(t):
    terms = ["small", "ring"]
    words = search.words(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))).cast("long").alias("hits")).where(F.col("hits") >= min(2, len(terms)))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other, min(doc_id) AS example FROM documents GROUP BY 1")
def ui_summary(t):
    return t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"), F.min("doc_id").alias("example"))


@query("SELECT a.doc_id, a.quality, a.toxic FROM labels a WHERE a.toxic = 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = a.doc_id)")
def evidence_exists(t):
    return relational.existing_only(t.labels.where("toxic = 1"), t.documents, "doc_id", "doc_id").select("doc_id", "quality", "toxic")


