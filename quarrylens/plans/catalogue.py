"""The operators instantiated on the fixture tables, each with the same query in SQL.

Concepts map to tables as follows: modules are orders, methods are line items, edges link suppliers and
customers, objects are parts, groups are nations and regions, texts are documents and pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import graph, mining, practices, relational, resolve, search, vectors
from ..operators.stage import dealt, tasks
from ..sources import modules
from ..streaming import incremental
from . import sqlguard
from .registry import Tables, query

EDGES_SQL = "WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), edges AS (SELECT c_custkey AS src, (c_custkey * 7 + 13) % n + 1 AS dst FROM customer, n UNION SELECT c_custkey, (c_custkey * 3) % n + 1 FROM customer, n)"


def edges(t: Tables) -> DataFrame:
    """A sparse directed graph over customers."""
    n = F.broadcast(t.customer.agg(F.count(F.lit(1)).alias("n")))
    rows = t.customer.select("c_custkey").crossJoin(n)
    first = rows.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 13) % F.col("n") + 1).alias("dst"))
    return first.unionByName(rows.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 3) % F.col("n") + 1).alias("dst"))).distinct()


CALLS_SQL = """WITH calls AS (SELECT l_orderkey AS id, 'M' || (l_suppkey % 10)::BIGINT AS caller_module,
 CASE l_linenumber % 5 WHEN 0 THEN 'Run' || (l_partkey % 20)::BIGINT WHEN 1 THEN 'M' || (l_partkey % 15)::BIGINT || '.Run' || (l_partkey % 20)::BIGINT
 WHEN 2 THEN 'Справочники.X' WHEN 3 THEN 'obj.Write' ELSE 'Message' END AS callee_name FROM lineitem),
methods AS (SELECT DISTINCT 'M' || (s_suppkey % 10)::BIGINT AS module, 'run' || (s_suppkey % 12)::BIGINT AS name, ((s_suppkey % 12) % 3 > 0)::INT AS is_export FROM supplier),
common AS (SELECT DISTINCT module FROM methods),
r AS (SELECT c.*, strpos(callee_name, '.') AS dot, lower(split_part(callee_name, '.', 1)) AS head, lower(split_part(callee_name, '.', -1)) AS tail FROM calls c),
x AS (SELECT r.*, own.name IS NOT NULL AS own, a.name IS NOT NULL AS anyw, cm.module AS cm, e.ex FROM r
 LEFT JOIN methods own ON own.module = r.caller_module AND own.name = r.tail
 LEFT JOIN (SELECT DISTINCT name FROM methods) a ON a.name = r.tail
 LEFT JOIN common cm ON lower(cm.module) = r.head
 LEFT JOIN (SELECT module, name, max(is_export) AS ex FROM methods GROUP BY ALL) e ON e.module = cm.module AND e.name = r.tail),
resolved AS (SELECT id, CASE WHEN dot = 0 AND own THEN 'local' WHEN dot = 0 AND NOT anyw THEN 'platform_global' WHEN dot = 0 THEN 'unknown'
 WHEN cm IS NOT NULL THEN 'common_module' WHEN head IN ('справочники', 'документы') THEN 'object_manager' ELSE 'platform_var' END AS resolution,
 CASE WHEN dot = 0 AND own THEN caller_module || '::' || tail WHEN dot > 0 AND ex IS NOT NULL THEN cm || '::' || tail END AS callee_key,
 CASE WHEN dot = 0 AND own THEN 1.0 WHEN dot > 0 AND ex = 1 THEN 1.0 WHEN dot > 0 AND ex IS NOT NULL THEN 0.6 ELSE 0.0 END AS confidence FROM x) """


def resolved_calls(t: Tables) -> DataFrame:
    """Synthetic calls from line items, resolved against methods made from suppliers."""
    num = lambda c, m: (F.col(c) % m).cast("string")
    kind = F.col("l_linenumber") % 5
    name = F.when(kind == 0, F.concat(F.lit("Run"), num("l_partkey", 20))).when(kind == 1, F.concat(F.lit("M"), num("l_partkey", 15), F.lit(".Run"), num("l_partkey", 20))).when(kind == 2, "Справочники.X").when(kind == 3, "obj.Write").otherwise("Message")
    calls = t.lineitem.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("M"), num("l_suppkey", 10)).alias("caller_module"), name.alias("callee_name"))
    methods = t.supplier.select(F.concat(F.lit("M"), num("s_suppkey", 10)).alias("module"), F.concat(F.lit("run"), num("s_suppkey", 12)).alias("name"), ((F.col("s_suppkey") % 12) % 3 > 0).cast("int").alias("is_export")).distinct()
    return resolve.resolve(calls, methods, methods.select("module", F.col("module").alias("common_name")).distinct())


@query(CALLS_SQL + "SELECT resolution, count(*) AS n, count(callee_key) AS with_key, round(avg(confidence), 6) AS confidence FROM resolved GROUP BY resolution")
def resolution_classes(t):
    return resolved_calls(t).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"), F.count("callee_key").alias("with_key"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(CALLS_SQL + """SELECT count(*) AS total, count(callee_key) AS resolved, count(*) FILTER (resolution NOT IN ('platform_var', 'platform_global')) AS resolvable,
 round(100 * count(callee_key) / count(*), 1) AS pct_of_all, round(100 * count(callee_key) / count(*) FILTER (resolution NOT IN ('platform_var', 'platform_global')), 1) AS pct_of_resolvable FROM resolved""")
def coverage_classes(t):
    return resolve.coverage(resolved_calls(t))


WALK_SQL = EDGES_SQL + """, w AS (SELECT c_custkey AS node, 0 AS hop, c_custkey AS via FROM customer WHERE c_custkey IN (1, 5, 77)
 UNION SELECT e.{to}, w.hop + 1, w.via FROM w JOIN edges e ON e.{at} = w.node WHERE w.hop < {depth}),
 m AS (SELECT node, min(hop) AS hop FROM w GROUP BY node), reached AS (SELECT m.node, m.hop::BIGINT AS hop, min(w.via) AS via FROM m JOIN w ON w.node = m.node AND w.hop = m.hop WHERE m.hop > 0 GROUP BY ALL) """


def _walk(t, inbound, depth):
    return graph.walk(t.customer.where(F.col("c_custkey").isin(1, 5, 77)).select("c_custkey"), edges(t), depth, inbound)


@query(WALK_SQL.format(to="src", at="dst", depth=2) + "SELECT node, hop, via FROM reached")
def callers_bfs(t):
    return _walk(t, True, 2)


@query(WALK_SQL.format(to="src", at="dst", depth=4) + "SELECT node, hop FROM reached")
def radius_by_name(t):
    return _walk(t, True, 4).select("node", "hop")


@query(WALK_SQL.format(to="dst", at="src", depth=3) + "SELECT node, hop FROM reached")
def dependencies_by_name(t):
    return _walk(t, False, 3).select("node", "hop")


@query(WALK_SQL.format(to="src", at="dst", depth=4) + "SELECT CASE WHEN hop <= 1 THEN 'CRITICAL' WHEN hop = 2 THEN 'HIGH' WHEN hop = 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM reached GROUP BY 1")
def risk_summary(t):
    return graph.risk_summary(_walk(t, True, 4))


@query("SELECT s_suppkey AS node, count(l_suppkey) AS n, CASE WHEN count(l_suppkey) > 10 THEN 'high' WHEN count(l_suppkey) > 0 THEN 'medium' ELSE 'unknown' END AS risk FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49 GROUP BY 1")
def impact_risk(t):
    n = t.lineitem.where("l_quantity > 49").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    joined = t.supplier.join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("node"), F.coalesce("n", F.lit(0)).alias("n"))
    return joined.withColumn("risk", graph.impact(F.col("n")))


@query(EDGES_SQL + "SELECT c_custkey, (SELECT count(*) FROM edges WHERE dst = c_custkey) AS in_degree, (SELECT count(*) FROM edges WHERE src = c_custkey) AS out_degree FROM customer")
def method_degree(t):
    return graph.degrees(t.customer.select("c_custkey"), edges(t), "c_custkey")


@query("SELECT 'subscription' AS source, s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'job', c_custkey, c_name FROM customer WHERE c_acctbal < -900")
def platform_entrypoints(t):
    a = t.supplier.where("s_acctbal < 0").select(F.lit("subscription").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return relational.union_references([a, t.customer.where("c_acctbal < -900").select(F.lit("job").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))])


REGIONS_SQL = """regions AS (SELECT o_orderkey AS k, 1 + (o_orderkey % 3) AS "start", CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 4 + (o_orderkey % 3) END AS "end", 'outer' AS region FROM orders
 UNION ALL SELECT o_orderkey, 2 + (o_orderkey % 3), 3 + (o_orderkey % 3), 'inner' FROM orders UNION ALL SELECT o_orderkey, 6, 7, 'tail' FROM orders)"""


def _regions(t):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 3
    row = lambda s, e, n: t.orders.select(k.alias("k"), s.cast("long").alias("start"), e.cast("long").alias("end"), F.lit(n).alias("region"))
    return row(1 + m, F.when(k % 7 != 0, 4 + m), "outer").unionByName(row(2 + m, 3 + m, "inner")).unionByName(row(F.lit(6), F.lit(7), "tail"))


@query("WITH " + REGIONS_SQL + """ SELECT l_orderkey AS k, l_linenumber::BIGINT AS line, (SELECT region FROM regions r WHERE r.k = l_orderkey AND r."start" <= l_linenumber AND (r."end" IS NULL OR r."end" >= l_linenumber)
 ORDER BY r."start" DESC, coalesce(r."end", 4611686018427387904), region DESC LIMIT 1) AS region, count(*) AS n FROM lineitem GROUP BY ALL""")
def module_outline_regions(t):
    regions = _regions(t)
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"))
    points = dealt(lines, "k", n=tasks(lines, regions)).groupBy("k", "line").agg(F.count(F.lit(1)).alias("n")).withColumn("pid", F.struct("k", "line"))
    return relational.innermost_interval(points, regions, "k", "line", "pid", "region").select("k", "line", "region", "n")


@query("WITH " + REGIONS_SQL + """, m AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY "start", "end" NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM regions)
 SELECT k, "start"::BIGINT AS "start", region FROM m WHERE before IS NULL OR before < "start\"""")
def toplevel_regions(t):
    return relational.top_level(_regions(t), "k").select("k", "start", "region")


@query("""WITH o AS (SELECT c_custkey AS id, 'Customer#' || lpad((c_custkey * 2)::VARCHAR, 9, '0') AS method, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE 'none' END AS module FROM customer)
 SELECT id, (SELECT min(c_custkey) FROM customer c WHERE lower(c.c_mktsegment) = lower(o.module) AND lower(c.c_name) = lower(o.method)) AS target_line FROM o""")
def override_target_resolution(t):
    key = F.col("c_custkey")
    overrides = t.customer.select(key.alias("id"), F.concat(F.lit("Customer#"), F.lpad((key * 2).cast("string"), 9, "0")).alias("method"), F.when(key % 2 == 0, "BUILDING").otherwise("none").alias("module"))
    return relational.resolve_override(overrides, t.customer.select(F.col("c_mktsegment").alias("module"), F.col("c_name").alias("name"), key.alias("line"))).select("id", "target_line")


@query("SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS customers FROM region")
def extensions_overview(t):
    nations = t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"))
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("rk")).agg(F.count(F.lit(1)).alias("customers"))
    joined = t.region.join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left").join(customers, F.col("r_regionkey") == F.col("rk"), "left")
    return joined.select("r_name", F.coalesce("nations", F.lit(0)).alias("nations"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE lower('Order.' || l_orderkey::BIGINT) = lower('ORDER.7')")
def movements_exact(t):
    return t.lineitem.where(T.same(F.concat(F.lit("Order."), F.col("l_orderkey").cast("string")), "ORDER.7")).select("l_orderkey", "l_suppkey").distinct()


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('SMALL'))")
def movements_substring(t):
    return t.part.where(T.has(F.col("p_name"), "SMALL")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part WHERE lower('Part.' || p_partkey::BIGINT) = 'part.12' OR starts_with('part.' || p_partkey::BIGINT || '.x', 'part.12.')")
def self_or_element(t):
    path = F.concat(F.lit("part."), F.col("p_partkey").cast("string"), F.lit(".x"))
    return t.part.where(T.self_or_element(path, "part.12")).select("p_partkey", "p_brand")


HOME_SQL = "WITH content AS (SELECT DISTINCT c_nationkey AS member, c_mktsegment AS grp FROM customer), s AS (SELECT *, count(*) OVER (PARTITION BY grp) AS group_size FROM content), r AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY group_size, grp) AS rn FROM s) "


@query(HOME_SQL + "SELECT member, grp, group_size FROM r WHERE rn = 1")
def home_subsystem(t):
    return relational.home_group(t.customer.select(F.col("c_nationkey").alias("member"), F.col("c_mktsegment").alias("grp")).distinct(), "member", "grp")


@query("SELECT c_mktsegment, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS debtors, sum(CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END)::BIGINT AS rich, min(c_name) AS first_name, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def subsystem_kinds(t):
    flag = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    return t.customer.groupBy("c_mktsegment").agg(flag("c_acctbal < 0").alias("debtors"), flag("c_acctbal >= 5000").alias("rich"), F.min("c_name").alias("first_name"), F.count_distinct("c_nationkey").alias("nations"))


@query("WITH m AS (SELECT 'S' || l_suppkey::BIGINT AS src, 'P' || (l_partkey % 50)::BIGINT AS dst FROM lineitem), s AS (SELECT src AS node, 'source' AS side FROM m UNION ALL SELECT dst, 'target' FROM m) SELECT node, side, count(*) AS weight FROM s GROUP BY ALL ORDER BY weight DESC, side, node LIMIT 25")
def movement_graph_topn(t):
    m = t.lineitem.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("dst"))
    return graph.top_nodes(m, 25)


REFS_SQL = "refs AS (SELECT c_name AS source_object, 'Nation.' || n_name AS ref_object, 'customer_nation' AS ref_kind FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, 'Nation.' || n_name, 'supplier_nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'Region.' || r_name, 'nation_region' FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _references(t):
    ref = lambda df, name, kind, prefix, target: df.select(F.col(name).alias("source_object"), F.concat(F.lit(prefix), F.col(target)).alias("ref_object"), F.lit(kind).alias("ref_kind"))
    nation = F.broadcast(t.nation)  # fixed size: 25 rows
    return relational.union_references([
        ref(t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "customer_nation", "Nation.", "n_name"),
        ref(t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "supplier_nation", "Nation.", "n_name"),
        ref(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "nation_region", "Region.", "r_name"),
    ])


@query("WITH " + REFS_SQL + " SELECT * FROM refs WHERE ref_object = 'Nation.FRANCE' OR starts_with(ref_object, 'Region.')")
def references_union(t):
    return _references(t).where((F.col("ref_object") == "Nation.FRANCE") | F.col("ref_object").startswith("Region."))


@query("WITH " + REFS_SQL + " SELECT ref_kind, count(*) AS n, count(DISTINCT ref_object) AS objects FROM refs GROUP BY 1")
def reference_kind_counts(t):
    return _references(t).groupBy("ref_kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ref_object").alias("objects"))


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS readers, count(*) AS uses FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1")
def dcs_readers(t):
    return t.lineitem.join(t.part.where("p_size > 40"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_distinct("l_suppkey").alias("readers"), F.count(F.lit(1)).alias("uses"))


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) IN ('click', 'purchase')")
def usages_existing_only(t):
    registry = t.spark.createDataFrame([("CLICK",), ("Purchase",)], "name string")
    return relational.existing_only(t.events.select("event_id", "event_type"), registry, "event_type", "name")


@query("SELECT lower(c_name) AS name, 'base' AS origin FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT lower(c_name), 'extension' FROM customer WHERE c_acctbal < 0")
def extension_dedupe(t):
    base = t.customer.where("c_acctbal >= 0").select(F.lower("c_name").alias("name"), F.lit("base").alias("origin"))
    return relational.base_wins(base, t.customer.select(F.lower("c_name").alias("name"), F.lit("extension").alias("origin")), ["name"])


WORDS_SQL = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 1)"
TOKENS_SQL = "tok AS (SELECT p_partkey AS id, unnest(" + WORDS_SQL.format(c="p_name") + ") AS token FROM part)"


def _tokens(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(search.words(F.col("p_name"))).alias("token"))


@query("WITH " + TOKENS_SQL + ", n AS (SELECT count(DISTINCT id) AS n FROM tok) SELECT token, count(DISTINCT id) AS df, round(ln((any_value(n) + 1) / (count(DISTINCT id) + 1)), 9) AS idf FROM tok, n GROUP BY token")
def token_idf(t):
    return search.token_idf(_tokens(t), "id", "token").withColumn("idf", F.round("idf", 9))


@query("WITH " + TOKENS_SQL + ", n AS (SELECT count(DISTINCT id) AS n FROM tok), i AS (SELECT token, ln((any_value(n) + 1) / (count(DISTINCT id) + 1)) AS idf FROM tok, n GROUP BY token) SELECT round(avg(coalesce(idf, 1.0)), 9) AS idf FROM (VALUES ('small'), ('ring'), ('nosuchtoken')) q(q) LEFT JOIN i ON q = token")
def query_idf(t):
    return search.query_idf(search.token_idf(_tokens(t), "id", "token"), ["small", "ring", "nosuchtoken"]).select(F.round("idf", 9).alias("idf"))


def _bm25_sql(source: str, id_col: str, fields: dict[str, float], terms: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT {id_col} AS id, '{c}' AS field, {w}::DOUBLE AS weight, {WORDS_SQL.format(c=c)} AS w FROM {source}" for c, w in fields.items() if w)
    tfs = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS tf{i}" for i, x in enumerate(terms))
    dfs = ", ".join(f"count(CASE WHEN tf{i} > 0 THEN 1 END) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(terms)))
    matched = " + ".join(f"(max(tf{i}) > 0)::INT" for i in range(len(terms)))
    return f"WITH r AS ({rows}), f AS (SELECT id, field, weight, len(w) AS len, {tfs} FROM r), s AS (SELECT field, avg(len) AS avg_len, count(*) AS n, {dfs} FROM f GROUP BY field), b AS (SELECT id, sum(weight * ({parts})) AS score, ({matched})::BIGINT AS matched FROM f JOIN s USING (field) GROUP BY id) "


@query(_bm25_sql("documents", "doc_id", {"text": 1.0}, ["the", "ingthe", "license"]) + "SELECT id, round(score, 6) AS score, matched FROM b WHERE matched >= 2")
def bm25_documents(t):
    return search.bm25(t.documents, "doc_id", {"text": 1.0}, ["the", "ingthe", "license"], 2).withColumn("score", F.round("score", 6))


@query(_bm25_sql("part", "p_partkey", {"p_name": 5.0, "p_type": 2.0, "p_brand": 1.0}, ["small", "ring", "promo"]) + "SELECT id, round(score, 6) AS score FROM b WHERE matched >= 1 AND (matched = 3 OR (SELECT max(matched) FROM b) < 3)")
def bm25_weighted(t):
    return search.and_then_or(t.part, "p_partkey", {"p_name": 5.0, "p_type": 2.0, "p_brand": 1.0}, ["small", "ring", "promo"]).select("id", F.round("score", 6).alias("score"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT h, min(doc_id) AS doc_id, count(*) - 1 AS alternates, array_to_string(list_sort(list(doc_id))[2:], ',') AS others FROM d GROUP BY h HAVING count(*) > 1")
def kb_dedupe_alternates(t):
    d = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).groupBy("h").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return d.where(F.size("ids") > 1).select("h", F.col("ids")[0].alias("doc_id"), (F.size("ids") - 1).cast("long").alias("alternates"), F.array_join(F.slice("ids", 2, 1_000_000_000).cast("array<string>"), ",").alias("others"))


GREP_SQL = "WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT id, line::BIGINT AS line, CASE WHEN length(trim(raw, ' ')) > 200 THEN left(trim(raw, ' '), 200) || '…' ELSE trim(raw, ' ') END AS text FROM l WHERE "


@query(GREP_SQL + "contains(lower(raw), 'license')")
def grep_literal(t):
    return search.grep(t.documents, "doc_id", "text", "LICENSE")


@query(GREP_SQL + "regexp_matches(raw, 'AKIA[A-Z0-9]{16}|[0-9]{1,3}(\\.[0-9]{1,3}){3}')")
def grep_regex(t):
    return search.grep(t.documents, "doc_id", "text", r"AKIA[A-Z0-9]{16}|[0-9]{1,3}(\.[0-9]{1,3}){3}", regex=True, case_sensitive=True)


def _html_sql(c: str) -> str:
    out = f"regexp_replace({c}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6])>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    out = f"replace(replace(replace({out}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<')"
    out = f"replace(replace(replace({out}, '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39))"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


@query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_to_text_pages(t):
    return t.pages.select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("""WITH o AS (SELECT page_id, sha256(html) AS h FROM pages WHERE NOT contains(url, '?')), n AS (SELECT page_id, CASE WHEN contains(url, 'blog') THEN sha256(html || 'x') ELSE sha256(html) END AS h FROM pages WHERE NOT contains(url, '#'))
 SELECT coalesce(n.page_id, o.page_id) AS page_id, CASE WHEN o.page_id IS NULL THEN 'added' WHEN n.page_id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS state FROM o FULL JOIN n ON o.page_id = n.page_id""")
def help_sync_diff(t):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    html = F.col("html")
    old = t.pages.where("NOT contains(url, '?')").select("page_id", sha(html).alias("h"))
    new = t.pages.where("NOT contains(url, '#')").select("page_id", F.when(F.contains("url", F.lit("blog")), sha(F.concat(html, F.lit("x")))).otherwise(sha(html)).alias("h"))
    return incremental.sync_diff(old, new, "page_id", "h")


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS cosine FROM embeddings, q WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20")
def cosine_topk(t):
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return vectors.top_k(t.embeddings.where("vec_id <> 0"), "vec_id", "embedding", q, 20).withColumn("cosine", F.round("cosine", 6))


SIGNALS = ("exact", "synonym", "bm25", "semantic", "idf", "usage", "degree")


def _candidates(t):
    """Parts as candidates of a search for ``small``, with simple signals."""
    n = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("uses"))
    p = t.part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    name = F.split("p_name", " ")[0]
    return p.select(
        F.col("p_type").alias("kind"), name.alias("name"), F.col("p_partkey").alias("payload"), T.name_precision(name, "re").alias("exact"), T.has(F.col("p_type"), "promo").cast("double").alias("synonym"),
        T.lexical_weight(F.col("p_name"), ["small", "ring"]).cast("double").alias("bm25"), (F.col("p_size") / 50.0).alias("semantic"), F.lit(0.5).alias("idf"), F.log1p("uses").alias("usage"), F.col("uses").cast("double").alias("degree"),
    )


CANDIDATES_SQL = """p AS (SELECT *, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS uses, split_part(p_name, ' ', 1) AS nm FROM part),
 cand AS (SELECT p_type AS kind, nm AS name, p_partkey AS payload, CASE WHEN lower(nm) = 're' THEN 1.0 WHEN starts_with(lower(nm), 're') THEN 0.5 WHEN contains(lower(nm), 're') THEN 0.25 ELSE 0.0 END::DOUBLE AS exact,
 contains(lower(p_type), 'promo')::INT::DOUBLE AS synonym, (CASE WHEN contains(lower(p_name), 'small') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_name), 'ring') THEN 4 ELSE 0 END)::DOUBLE AS bm25,
 p_size / 50.0::DOUBLE AS semantic, 0.5::DOUBLE AS idf, ln(1 + uses) AS usage, uses::DOUBLE AS degree FROM p),
 merged AS (SELECT kind, lower(name) AS name_lc, arg_max(name, {'d': degree, 'p': payload}) AS name, arg_max(payload, {'d': degree, 'p': payload}) AS payload, """ + ", ".join(f"max({s}) AS {s}" for s in SIGNALS) + ", count(DISTINCT payload) - 1 AS others FROM cand GROUP BY 1, 2)"
FUSED_SQL = ", lim AS (SELECT " + ", ".join(f"min({s}) AS lo_{s}, max({s}) AS hi_{s}" for s in SIGNALS) + " FROM merged), norm AS (SELECT kind, name, payload, others, " + ", ".join(f"CASE WHEN hi_{s} > lo_{s} THEN ({s} - lo_{s}) / (hi_{s} - lo_{s}) ELSE 0.0 END AS {s}" for s in SIGNALS) + " FROM merged, lim), fused AS (SELECT *, " + " + ".join(f"{s} * {search.WEIGHTS[s]}" for s in SIGNALS) + " AS score FROM norm)"


@query("WITH " + CANDIDATES_SQL + " SELECT kind, name, payload, others, round(usage, 6) AS usage FROM merged")
def namesakes_by_category(t):
    return relational.collapse_namesakes(_candidates(t), list(SIGNALS)).select("kind", "name", "payload", "others", F.round("usage", 6).alias("usage"))


def _fused(t):
    return search.fuse(relational.collapse_namesakes(_candidates(t), list(SIGNALS)))


@query("WITH " + CANDIDATES_SQL + FUSED_SQL + " SELECT kind, name, others, round(score, 6) AS score FROM fused")
def rank_fusion(t):
    return _fused(t).select("kind", "name", "others", F.round("score", 6).alias("score"))


@query("WITH " + CANDIDATES_SQL + FUSED_SQL + ", k AS (SELECT *, row_number() OVER (ORDER BY score DESC, strlen(name), name, kind) AS rn, count(*) FILTER (score >= 0.25) OVER () AS strong FROM fused) SELECT kind, name, round(score, 3) AS score FROM k WHERE score >= 0.25 OR strong < 3 AND rn <= 3 ORDER BY score DESC, strlen(name), name, kind LIMIT 20")
def find_ranked(t):
    return search.cut_off(_fused(t)).orderBy(F.desc("score"), F.octet_length("name"), "name", "kind").limit(20).select("kind", "name", F.round("score", 3).alias("score"))


@query("SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small' THEN 1.0 WHEN starts_with(lower(p_name), 'small') THEN 0.5 WHEN contains(lower(p_name), 'small') THEN 0.25 ELSE 0.0 END::DOUBLE AS precision FROM part ORDER BY precision DESC, length(p_name), p_partkey LIMIT 30")
def find_exact_prefix(t):
    p = T.name_precision(F.col("p_name"), "small")
    return t.part.select("p_partkey", "p_name", p.alias("precision")).orderBy(F.desc("precision"), F.length("p_name"), "p_partkey").limit(30)


@query("""WITH q AS (SELECT list_distinct(list_transform(range(1, length('customer#000000012') - 1), lambda i: substr('customer#000000012', i, 3))) AS q), n AS (SELECT DISTINCT c_name AS name FROM customer),
 g AS (SELECT name, list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3))) AS g FROM n), s AS (SELECT name, round(len(list_intersect(g, q)) / greatest(len(g), len(q)), 6) AS similarity FROM g, q)
 SELECT name, similarity FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, name LIMIT 5""")
def similar_names_trigram(t):
    return search.similar_names(t.customer, "c_name", "Customer#000000012")


@query("SELECT p_partkey, CASE WHEN len(ts) = 1 THEN ts[1] END AS only_type, len(ts)::BIGINT AS n_types FROM (SELECT p_partkey, string_split(p_type, ' ') AS ts FROM part)")
def object_card_attributes(t):
    types = F.split("p_type", " ")
    return t.part.select("p_partkey", F.when(F.size(types) == 1, types[0]).alias("only_type"), F.size(types).cast("long").alias("n_types"))


@query("SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'small') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_name), 'blue') THEN 4 ELSE 0 END)::BIGINT AS weight, (contains(lower(p_name), 'small')::INT + contains(lower(p_name), 'blue')::INT)::BIGINT AS matched FROM part")
def lexical_weight(t):
    terms = ["Small", "Blue"]
    return t.part.select("p_partkey", T.lexical_weight(F.col("p_name"), terms).alias("weight"), T.match_count(F.col("p_name"), terms).alias("matched"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, array_to_string(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')[:-2], '/') AS dir_path,
 string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')[-1] AS filename, (len(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')) - 1)::BIGINT AS depth FROM pages""")
def path_split(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    parts = T.path_parts(F.col("path"))
    return t.pages.select("page_id", path.alias("path")).select("page_id", "path", parts["dir_path"].alias("dir_path"), parts["filename"].alias("filename"), parts["depth"].alias("depth"))


TOKEN_SQL = "list_transform(list_filter(regexp_extract_all({c}, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))"


@query("SELECT c_custkey, array_to_string(" + TOKEN_SQL.format(c="c_name || c_mktsegment") + ", ' ') AS tokens FROM customer")
def tokenize_names(t):
    return t.customer.select("c_custkey", F.array_join(T.tokenize_name(F.concat("c_name", "c_mktsegment")), " ").alias("tokens"))


BASKETS_SQL = "ev AS (SELECT l_orderkey AS basket, p_brand AS symbol, l_linenumber AS pos, l_returnflag AS ctx, l_linestatus AS form, p_type AS ptype FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _events(t):
    p = t.part.select("p_partkey", "p_brand", "p_type")
    return t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("symbol"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_returnflag").alias("ctx"), F.col("l_linestatus").alias("form"), F.col("p_type").alias("ptype"))


@query("WITH " + BASKETS_SQL + """, k AS (SELECT DISTINCT basket, symbol FROM ev), d AS (SELECT symbol, count(*) AS df FROM k GROUP BY 1 HAVING count(*) >= 20), n AS (SELECT count(DISTINCT basket) AS n FROM ev),
 f AS (SELECT k.* FROM k JOIN d USING (symbol)), pr AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS support FROM f x JOIN f y ON x.basket = y.basket AND x.symbol <> y.symbol GROUP BY 1, 2 HAVING count(*) >= 20)
 SELECT a, b, support, round(support / da.df, 6) AS confidence, round(support * n / (da.df * db.df), 6) AS lift FROM pr JOIN d da ON da.symbol = a JOIN d db ON db.symbol = b, n WHERE support / da.df >= 0.05 AND support * n / (da.df * db.df) >= 0.9""")
def assoc_rules(t):
    return mining.associations(_events(t), "basket", "symbol", 20, 0.05, 0.9).withColumns({"confidence": F.round("confidence", 6), "lift": F.round("lift", 6)})


@query("WITH " + BASKETS_SQL + """, d AS (SELECT symbol FROM ev GROUP BY 1 HAVING count(DISTINCT basket) >= 50), s AS (SELECT basket, symbol, min(pos) AS lo, max(pos) AS hi, count(*) AS c FROM ev SEMI JOIN d USING (symbol) GROUP BY 1, 2)
 SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(avg((x.lo < y.lo)::INT), 6) AS first_before, round(avg((x.hi < y.lo)::INT), 6) AS all_before FROM s x JOIN s y ON x.basket = y.basket AND x.symbol <> y.symbol GROUP BY 1, 2 HAVING count(*) >= 50""")
def pair_relations(t):
    return mining.pair_relations(_events(t), "basket", "symbol", "pos", 50).select("a", "b", "n", F.round("first_before", 6).alias("first_before"), F.round("all_before", 6).alias("all_before"))


GRID_SQL = "WITH " + BASKETS_SQL + ", r AS (SELECT DISTINCT basket, {symbol} AS symbol, {ctx} AS ctx FROM ev), c AS (SELECT ctx, count(DISTINCT basket) AS n_context FROM r GROUP BY 1), tot AS (SELECT count(DISTINCT basket) AS total FROM r), s AS (SELECT symbol, count(DISTINCT basket) AS n_symbol FROM r GROUP BY 1 HAVING count(DISTINCT basket) >= {least}), o AS (SELECT symbol, ctx, count(DISTINCT basket) AS observed FROM r GROUP BY 1, 2), g AS (SELECT s.symbol, c.ctx AS context, coalesce(o.observed, 0) AS observed, n_symbol, n_context, total, n_symbol * n_context / total AS expected FROM s CROSS JOIN c CROSS JOIN tot LEFT JOIN o ON o.symbol = s.symbol AND o.ctx = c.ctx) "


def _grid(t, symbol, context, least):
    return mining.contexts(_events(t), "basket", symbol, context, least)


@query(GRID_SQL.format(symbol="ptype", ctx="symbol || form", least=30) + ", p AS (SELECT *, list_sum(list_transform(range(0, observed::BIGINT + 1), lambda k: exp(k * ln(expected) - expected - lgamma(k + 1.0)))) AS tail FROM g) SELECT symbol, context, observed, round(expected, 6) AS expected FROM p WHERE expected > 0 AND observed <= 0.2 * expected AND tail <= 0.001")
def avoid_context(t):
    e = _events(t).withColumn("sf", F.concat("symbol", "form"))
    return mining.avoided(mining.contexts(e, "basket", "ptype", "sf", 30)).select("symbol", "context", "observed", F.round("expected", 6).alias("expected"))


@query(GRID_SQL.format(symbol="form", ctx="ctx", least=1) + "SELECT symbol, context, observed, n_context FROM g WHERE n_context >= 20 AND observed >= 0.5 * n_context AND n_symbol / total < 0.9")
def require_context(t):
    return mining.required(_grid(t, "form", "ctx", 1), 20, 0.5, 0.9).select("symbol", "context", "observed", "n_context")


@query(GRID_SQL.format(symbol="symbol", ctx="ctx", least=20) + "SELECT symbol, context, observed, round(expected, 6) AS expected FROM g WHERE n_context >= 500 AND observed <= 0.6 * expected")
def avoid_directive(t):
    return mining.avoided_directives(_grid(t, "symbol", "ctx", 20), 500, 0.6).select("symbol", "context", "observed", F.round("expected", 6).alias("expected"))


@query("WITH e AS (SELECT event_type AS src, user_id % 40 AS dst FROM events), c AS (SELECT dst, src, count(*) AS inside FROM e GROUP BY ALL), tt AS (SELECT dst, count(*) AS total FROM e GROUP BY 1) SELECT dst AS wrapped, src AS wrapper, inside, total FROM c JOIN tt USING (dst) WHERE inside >= 30 AND total - inside <= 0.8 * total")
def wrapper_displacement(t):
    return mining.wrappers(t.events.select(F.col("event_type").alias("src"), (F.col("user_id") % 40).alias("dst")), 30, 0.8)


@query("""WITH nm AS (SELECT p_name AS name, count(*) AS cnt, list_distinct(list_transform(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0), lambda x: left(x, 5))) AS st FROM part GROUP BY 1)
 SELECT r.name AS rare, c.name AS common, round(len(list_intersect(r.st, c.st)) / len(list_distinct(list_concat(r.st, c.st))), 6) AS similarity FROM nm c JOIN nm r ON c.name <> r.name AND c.cnt >= 10 AND c.cnt >= 1.2 * r.cnt WHERE len(list_intersect(r.st, c.st)) > 0 AND len(list_intersect(r.st, c.st)) / len(list_distinct(list_concat(r.st, c.st))) >= 0.3""")
def similar_displacement(t):
    n = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("cnt"))
    return mining.similar_pairs(n, "p_name", "cnt", 0.3, 10, 1.2).withColumn("similarity", F.round("similarity", 6))


@query("WITH c AS (SELECT p_brand AS symbol, l_returnflag AS form, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), n AS (SELECT symbol, sum(k)::BIGINT AS n, arg_max(form, {'k': k, 'f': form}) AS form, max(k) AS k FROM c GROUP BY 1) SELECT symbol, form, n, round(k / n, 6) AS share FROM n WHERE n >= 30 AND k >= 0.3 * n")
def arg_form_dominance(t):
    return mining.dominant_form(_events(t), "symbol", "ctx", 30, 0.3).withColumn("share", F.round("share", 6))


@query(EDGES_SQL + """, fl AS (SELECT e.dst, max((a.c_mktsegment IS DISTINCT FROM b.c_mktsegment)::INT) AS f FROM edges e JOIN customer a ON a.c_custkey = e.dst JOIN customer b ON b.c_custkey = e.src GROUP BY 1)
 SELECT c_mktsegment AS grp, count(*) AS nodes, round(avg((f IS NULL)::INT), 6) AS unused_share, round(avg(coalesce(f = 0, false)::INT), 6) AS self_only_share FROM customer LEFT JOIN fl ON dst = c_custkey GROUP BY 1""")
def graph_unused_share(t):
    return mining.unused_shares(t.customer, edges(t), "c_custkey", "c_mktsegment").withColumns({"unused_share": F.round("unused_share", 6), "self_only_share": F.round("self_only_share", 6)})


@query("WITH n AS (SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 100), k AS (SELECT event_type AS symbol, CASE WHEN user_id % 10 < 7 THEN 'early' WHEN user_id % 10 < 9 THEN 'late' END AS parent, count(*) AS k FROM events GROUP BY ALL) SELECT symbol, parent, n, round(k / n, 6) AS share FROM k JOIN n USING (symbol) WHERE parent IS NOT NULL AND k >= 0.5 * n")
def nested_share(t):
    u = F.col("user_id") % 10
    e = t.events.select("event_type", F.when(u < 7, "early").when(u < 9, "late").alias("parent"))
    return mining.nested_shares(e, "event_type", "parent").withColumn("share", F.round("share", 6))


@query("""WITH f AS (SELECT p_type AS family, p_brand AS name, count(*) AS evidence, count(DISTINCT p_size) / count(*) AS diversity, count(DISTINCT p_size) AS spread, avg(p_retailprice) / 2000 AS fit FROM part GROUP BY ALL),
 s AS (SELECT *, least(evidence * diversity, 50.0) / 50 * ln(1 + spread) / ln(200.0) * greatest(fit, 0.0) AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(score, 9) DESC, name) AS rn FROM s) SELECT family, name, round(score, 6) AS score FROM r WHERE rn = 1""")
def practice_ranking(t):
    f = t.part.groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("evidence"), (F.count_distinct("p_size") / F.count(F.lit(1))).alias("diversity"), F.count_distinct("p_size").alias("spread"), (F.avg("p_retailprice") / 2000).alias("fit"))
    return mining.rank_practices(f, "family", "evidence", "diversity", "spread", 200, "fit").select("family", "name", F.round("score", 6).alias("score"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(count(DISTINCT user_id) / count(*), 6) AS share FROM events GROUP BY 1")
def operator_usage(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).withColumn("share", F.round(F.col("users") / F.col("n"), 6))


@query("""WITH f AS (SELECT user_id AS basket, event_type AS symbol, min(event_id) AS pos FROM events GROUP BY 1, 2), p AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS observed FROM f x JOIN f y ON x.basket = y.basket AND x.pos < y.pos GROUP BY 1, 2)
 SELECT p.a, p.b, p.observed, coalesce(q.observed, 0) AS inverse, round(p.observed / (p.observed + coalesce(q.observed, 0)), 6) AS consistency FROM p LEFT JOIN p q ON q.a = p.b AND q.b = p.a WHERE p.observed >= 10 AND p.observed / (p.observed + coalesce(q.observed, 0)) >= 0.5""")
def region_order_pairs(t):
    return mining.ordered_pairs(t.events, "user_id", "event_type", "event_id", 10, 0.5).select("a", "b", "observed", "inverse", F.round("consistency", 6).alias("consistency"))


@query("WITH w AS (SELECT user_id AS basket, event_type AS s0, lead(event_type, 1) OVER o AS s1, lead(event_type, 2) OVER o AS s2 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id, event_type)), g AS (SELECT DISTINCT basket, s0 || ' > ' || s1 || ' > ' || s2 AS gram FROM w WHERE s2 IS NOT NULL AND (s1 <> s0 OR s2 <> s0)) SELECT gram, count(*) AS baskets FROM g GROUP BY 1 HAVING count(*) >= 10")
def call_ngrams(t):
    return mining.sequences(t.events, "user_id", "event_type", "event_id")


@query("WITH h AS (SELECT event_type, event_id, substr(sha256(concat_ws('|', event_id::VARCHAR, user_id::VARCHAR)), 1, 16) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k) AS rn FROM h) SELECT event_type, event_id, k AS hash_key FROM r WHERE rn <= 10")
def minhash_evidence(t):
    return mining.evidence_sample(t.events, ["event_type"], [F.col("event_id").cast("string"), F.col("user_id").cast("string")]).select("event_type", "event_id", "hash_key")


@query("WITH h AS (SELECT doc_id, source, substr(sha256(doc_id::VARCHAR), 1, 16) AS k FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS rn FROM h) SELECT doc_id, source FROM r ORDER BY rn, source LIMIT 100")
def stratified_sample(t):
    return mining.stratified_sample(t.documents.select("doc_id", "source"), "source", F.col("doc_id")).select("doc_id", "source")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(*) >= 10")
def frequent_names(t):
    return t.lineitem.where("l_quantity > 45").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("SELECT user_id, 1 AS has_a, 1 AS has_b FROM events GROUP BY 1 HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'error')")
def pair_flags(t):
    return mining.pair_flags(t.events, "user_id", "event_type", "purchase", "error")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS p FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, {'c': c, 'p': -p}) AS event_type, max(c) AS n FROM c GROUP BY 1")
def most_common_first_seen(t):
    return mining.most_common(t.events, "user_id", "event_type", "event_id")


RULES_SQL = "rules AS (SELECT p_partkey AS id, p_type AS topic, CASE p_size % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'project' WHEN 2 THEN 'standard' ELSE 'observed' END AS authority FROM part)"


@query("WITH " + RULES_SQL + ", r AS (SELECT *, CASE authority WHEN 'customer' THEN 4 WHEN 'project' THEN 3 WHEN 'standard' THEN 2 ELSE 1 END AS k FROM rules), m AS (SELECT *, max(k) OVER (PARTITION BY topic) AS top FROM r) SELECT id, topic, authority, k = top AS stands FROM m")
def conflict_resolution(t):
    k = F.col("p_size") % 4
    rules = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("topic"), F.when(k == 0, "customer").when(k == 1, "project").when(k == 2, "standard").otherwise("observed").alias("authority"))
    stand, fall = practices.resolve_conflicts(rules)
    return stand.withColumn("stands", F.lit(True)).unionByName(fall.withColumn("stands", F.lit(False))).select("id", "topic", "authority", "stands")


@query("""WITH r AS (SELECT l_suppkey AS id, count(*) AS sample, count(*) FILTER (l_discount < 0.1) AS matches FROM lineitem GROUP BY 1), e AS (SELECT l_suppkey AS id, count(*) AS shown, count(*) FILTER (p_size = 50) AS missing FROM (SELECT DISTINCT l_suppkey, l_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48) GROUP BY 1)
 SELECT r.id, r.sample, r.matches, r.sample >= 10 AND r.matches >= 0.9 * r.sample AND coalesce(missing, 1) = 0 AND coalesce(shown, 0) > 0 AS verified FROM r LEFT JOIN e ON e.id = r.id""")
def rule_validation(t):
    rules = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("sample"), F.count_if(F.col("l_discount") < 0.1).alias("matches"))
    evidence = t.lineitem.where("l_quantity > 48").join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("address")).distinct()
    return practices.validate(rules, evidence, t.part.where("p_size <> 50").select("p_partkey"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def catalog_page(t):
    return relational.page(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 50, 25)[0]


@query("SELECT count(*) AS total, count(*) > 75 AS has_more, CASE WHEN count(*) > 75 THEN 75::BIGINT END AS next_offset FROM part")
def catalog_page_state(t):
    return relational.page(t.part, ["p_partkey"], 50, 25)[1]


UPSERT_SQL = "WITH nw AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F'), touched AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')) "


@query(UPSERT_SQL + "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM touched) UNION ALL SELECT * FROM nw)")
def incremental_upsert(t):
    columns = ("o_orderkey", "o_custkey", "o_totalprice")
    new = t.orders.where("o_orderstatus = 'F'").select(*columns).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return incremental.upsert(t.orders.select(*columns), new, "o_orderkey", t.orders.where("o_orderstatus IN ('F', 'P')")).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT 0::BIGINT AS added, count(*) FILTER (o_orderstatus = 'F') AS replaced, count(*) FILTER (o_orderstatus = 'P') AS removed FROM orders")
def incremental_report(t):
    return incremental.upsert_report(t.orders, t.orders.where("o_orderstatus = 'F'"), "o_orderkey", t.orders.where("o_orderstatus IN ('F', 'P')"))


@query("SELECT event_id, event_type FROM events WHERE user_id % 3 = 0 AND event_type IN ('click', 'error')")
def stale_edges(t):
    calls = t.events.select("event_id", F.col("event_type").alias("callee_name"), F.when(F.col("user_id") % 3 != 0, "known").alias("callee_key"))
    methods = t.spark.createDataFrame([("Click",), ("ERROR",)], "name string")
    return incremental.stale_edges(calls, methods).select("event_id", F.col("callee_name").alias("event_type"))


@query("WITH m AS (SELECT o_orderkey::VARCHAR AS path FROM orders WHERE epoch(o_orderdate) > epoch(TIMESTAMP '1998-01-01 00:00:00') + 1) SELECT count(*) AS changed, (SELECT array_to_string(list_sort(list(path)), ',') FROM (SELECT path FROM m ORDER BY path LIMIT 3)) AS examples, count(*) > 0 AS stale FROM m")
def freshness_report(t):
    files = t.orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return incremental.freshness(files, 883612800.0).withColumn("examples", F.array_join("examples", ","))


@query("SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'")
def sql_guarded(t):
    t.events.createOrReplaceTempView("guarded_events")
    statement = sqlguard.validate(t.spark, "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM guarded_events WHERE event_type = 'purchase' -- read only\n;")
    return t.spark.sql(statement).withColumn("n", F.col("n").cast("long"))


@query("SELECT l_suppkey, count(*) AS n, round(count(*) * ln(count(*) / 500.0) / ln(10.0) - (count(*) - 500.0) / ln(10.0), 6) AS above FROM lineitem GROUP BY 1 HAVING count(*) > 500")
def surprise_tail(t):
    n = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 500").withColumn("above", F.round(S.surprise_above(F.col("n"), F.lit(500.0)), 6))


@query("SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS category FROM pages")
def classify_paths(t):
    parts = modules.classify_path(F.regexp_replace("url", "^[a-z]+://", ""))
    return t.pages.select("page_id", parts["category"].alias("category"))


@query()
def random_index_vectors(t):
    idf = search.token_idf(_tokens(t), "id", "token")
    return vectors.entity_vectors(_tokens(t), "id", "token", idf, 64)


@query("SELECT r.o_orderpriority AS module, count(*) AS n FROM orders r GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders")
def table_summary(t):
    per = t.orders.groupBy(F.col("o_orderpriority").alias("module")).agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(t.orders.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("module"), "n"))


