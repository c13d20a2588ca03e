"""Conventions, mentions, paths and orders on the fixture tables; symbols are brands and types of ordered parts, baskets are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining, practices, relational, search
from ..operators.stage import dealt, tasks
from ..streaming import incremental
from .registry import query

USES_SQL = "u AS (SELECT l_orderkey AS basket, l_linenumber AS pos, 'P' || p_size % 7 || '.' || p_partkey % 5 AS symbol, 'P' || p_size % 7 AS root, o_orderpriority AS ctx FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE NOT (o_orderpriority = '1-URGENT' AND p_partkey % 5 = 3))"


def _uses(t):
    """Uses of symbols ``root.member`` in baskets with a context that avoids one member."""
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    n = tasks(lines, t.orders)
    rows = dealt(lines, "l_orderkey", n=n).join(dealt(t.orders, "o_orderkey", n=n), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.where("NOT (o_orderpriority = '1-URGENT' AND p_partkey % 5 = 3)")
    root = F.concat(F.lit("P"), (F.col("p_size") % 7).cast("string"))
    return rows.select(F.col("l_orderkey").alias("basket"), F.col("l_linenumber").alias("pos"), F.concat(root, F.lit("."), (F.col("p_partkey") % 5).cast("string")).alias("symbol"), root.alias("root"), F.col("o_orderpriority").alias("ctx"))


@query("WITH " + USES_SQL + """, r AS (SELECT root, count(DISTINCT basket) AS nr FROM u GROUP BY 1), k AS (SELECT root, ctx, count(DISTINCT basket) AS nk FROM u GROUP BY 1, 2), s AS (SELECT root, symbol, count(DISTINCT basket) AS ns FROM u GROUP BY 1, 2),
 o AS (SELECT root, symbol, ctx, count(DISTINCT basket) AS o FROM u GROUP BY 1, 2, 3), g AS (SELECT s.root, s.symbol, k.ctx, coalesce(o.o, 0) AS observed, nk * (ns - coalesce(o.o, 0))::DOUBLE / (nr - nk) AS expected FROM s JOIN k USING (root) JOIN r USING (root) LEFT JOIN o ON o.root = s.root AND o.symbol = s.symbol AND o.ctx = k.ctx WHERE nk >= 20 AND ns >= 30 AND nr > nk)
 SELECT root, symbol, ctx AS context, observed, round(expected, 6) AS expected FROM g WHERE observed = 0 AND expected >= 6.91""")
def avoid_within_root(t):
    found = mining.avoided_within_roots(_uses(t), "basket", "symbol", "ctx", F.col("root"))
    return found.where("observed = 0 AND expected >= 6.91").select("root", "symbol", "context", "observed", F.round("expected", 6).alias("expected"))


@query("WITH " + USES_SQL + """, m AS (SELECT basket, symbol, min(pos) AS lo, max(pos) AS hi FROM u GROUP BY 1, 2), b AS (SELECT x.basket, '[' || x.symbol || '..' || y.symbol || ']' AS block, x.lo AS f, y.hi AS t FROM m x JOIN m y ON x.basket = y.basket JOIN (VALUES ('P1.0', 'P2.1'), ('P3.2', 'P1.0'), ('P5.1', 'P5.2')) v(o, c) ON x.symbol = v.o AND y.symbol = v.c WHERE y.hi > x.lo),
 e AS (SELECT u.basket, symbol, block, pos > f AND pos < t AS inside FROM u JOIN b ON u.basket = b.basket), l AS (SELECT DISTINCT basket, block FROM e WHERE inside), p AS (SELECT block, symbol, count(*) AS n, count(*) FILTER (inside) AS observed FROM e JOIN l USING (basket, block) GROUP BY 1, 2)
 SELECT block, symbol, observed, round(n * sum(observed) OVER (PARTITION BY block) / sum(n) OVER (PARTITION BY block), 6) AS expected, n, round(observed / n, 6) AS share FROM p""")
def block_usage(t):
    uses = _uses(t).select("basket", "pos", "symbol")
    brackets = t.spark.createDataFrame([("P1.0", "P2.1"), ("P3.2", "P1.0"), ("P5.1", "P5.2")], "opening string, closing string")
    found = mining.block_contexts(mining.bracketed(uses, "basket", "symbol", "pos", brackets), "basket", "symbol", "block", "inside")
    return found.select("block", "symbol", "observed", F.round("expected", 6).alias("expected"), "n", F.round("share", 6).alias("share"))


@query("WITH " + USES_SQL + """, d AS (SELECT ctx, count(DISTINCT basket) AS nd FROM u GROUP BY 1), s AS (SELECT symbol, count(DISTINCT basket) AS na FROM u GROUP BY 1), o AS (SELECT symbol, ctx, count(DISTINCT basket) AS o FROM u GROUP BY 1, 2), n AS (SELECT count(DISTINCT basket) AS n FROM u)
 SELECT s.symbol, d.ctx AS directive, na AS n_symbol, nd AS n_directive, coalesce(o.o, 0) AS observed, round(nd * (na - coalesce(o.o, 0))::DOUBLE / greatest(n - nd, 1), 6) AS expected, n AS total FROM s CROSS JOIN d CROSS JOIN n LEFT JOIN o ON o.symbol = s.symbol AND o.ctx = d.ctx""")
def operators_by_directive(t):
    return mining.operator_usage(_uses(t), "basket", "symbol", "ctx").withColumn("expected", F.round("expected", 6))


@query("WITH " + USES_SQL + """, d AS (SELECT ctx, count(DISTINCT basket) AS nd FROM u GROUP BY 1), s AS (SELECT symbol, count(DISTINCT basket) AS na FROM u GROUP BY 1), o AS (SELECT symbol, ctx, count(DISTINCT basket) AS o FROM u GROUP BY 1, 2), n AS (SELECT count(DISTINCT basket) AS n FROM u)
 SELECT s.symbol, d.ctx AS directive, round(nd * na::DOUBLE / greatest(n - nd, 1), 6) AS expected FROM s CROSS JOIN d CROSS JOIN n LEFT JOIN o ON o.symbol = s.symbol AND o.ctx = d.ctx WHERE o.o IS NULL AND nd >= 500 AND na >= 30 AND nd * na::DOUBLE / greatest(n - nd, 1) >= 6.91""")
def operator_avoidance(t):
    found = mining.avoided_operators(mining.operator_usage(_uses(t), "basket", "symbol", "ctx"))
    return found.where("observed = 0 AND expected >= 6.91").select("symbol", "directive", F.round("expected", 6).alias("expected"))


@query("WITH " + USES_SQL + ", g AS (SELECT basket, string_agg(symbol, '|' ORDER BY symbol) AS sig FROM (SELECT DISTINCT basket, symbol FROM u) GROUP BY 1) SELECT symbol, count(*) AS baskets, count(DISTINCT sig) AS signatures, round(count(DISTINCT sig) / count(*), 6) AS diversity FROM (SELECT DISTINCT basket, symbol FROM u) JOIN g USING (basket) GROUP BY 1")
def signature_diversity(t):
    return mining.signature_diversity(_uses(t), "basket", "symbol").withColumn("diversity", F.round("diversity", 6))


@query("""WITH w AS (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS b, 'T' || regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g') AS m FROM part)
 SELECT p_partkey, 'Catalog.' || b AS object_ref, 'Ref' AS member, 'query' AS kind FROM w UNION ALL SELECT p_partkey, 'Document.' || m, NULL, 'ref_type' FROM w UNION ALL SELECT p_partkey, 'Report.' || b, NULL, 'query' FROM w""")
def literal_mentions(t):
    """The third word has a number for a name and names nothing; the fourth's empty segment is no member."""
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    brand, kind = name(F.col("p_brand")), F.concat(F.lit("T"), name(F.col("p_type")))
    text = F.concat(F.lit("x=Catalog."), brand, F.lit(".Ref, DocumentRef."), kind, F.lit(".No; document."), F.col("p_size").cast("string"), F.lit(".x http://Report."), brand, F.lit(".."))
    return t.part.select("p_partkey", F.explode(T.mentions(text)).alias("m")).select("p_partkey", "m.object_ref", "m.member", "m.kind")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'CommonModules/M' || page_id WHEN page_id % 3 = 1 THEN '../ext/E' || page_id % 5 || '/M' ELSE '/else/M' END AS rel_path, CASE WHEN page_id % 3 = 1 THEN 'E' || page_id % 5 END AS extension FROM pages""")
def extension_paths(t):
    k, five = F.col("page_id").cast("string"), (F.col("page_id") % 5).cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/d/src/CommonModules/M"), k)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/d/ext/E"), five, F.lit("/M"))).otherwise("/else/M")
    rows = t.pages.select("page_id", T.relative_to_source(path, "/d/src").alias("rel_path"))
    return rows.withColumn("extension", T.extension_of(F.col("rel_path")))


@query("SELECT c_custkey, to_json([c_mktsegment, 'a' || chr(34) || 'b' || chr(92), NULL])::VARCHAR AS encoded, c_mktsegment AS first_one, 'a' || chr(34) || 'b' || chr(92) AS second_one, 3::BIGINT AS n FROM customer")
def json_lists(t):
    made = t.customer.select("c_custkey", "c_mktsegment", T.json_strings(F.array("c_mktsegment", F.lit('a"b\\'), F.lit(None).cast("string"))).alias("encoded"))
    back = T.strings_of_json(F.col("encoded"))
    return made.select("c_custkey", "encoded", back[0].alias("first_one"), back[1].alias("second_one"), F.size(back).cast("long").alias("n"))


@query("SELECT n_name AS name, n_regionkey AS cluster, count(*) AS weight, row_number() OVER (ORDER BY n_regionkey, count(*) DESC, n_name) AS place FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def ring_order(t):
    """Nations on a ring: by cluster, heaviest first, then by name."""
    nodes = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("weight")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.ring_order(nodes.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("cluster"), "weight"))


@query("WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 400), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM h WHERE o_orderkey % 4 <> 0) SELECT o_orderkey, o_custkey, o_totalprice FROM f WHERE k = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def two_stage_top(t):
    """The best 400, then those that pass a filter, the best of each customer, and of those ten."""
    hits = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.two_stage_top(hits, [F.desc("o_totalprice"), F.asc("o_orderkey")], 400, F.col("o_orderkey") % 4 != 0, "o_custkey", 10)


@query("SELECT p_brand AS name, p_partkey AS place, p_size, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS of_name FROM part QUALIFY n <= 60")
def namesakes_cut(t):
    """All namesakes in one order, cut across them, with each name's full count."""
    rows = t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("place"), "p_size")
    return relational.cut_across(rows, "name", [F.asc("name"), F.desc("p_size"), F.asc("place")], 60)


@query("SELECT 'snapshot 7' AS answer_of, count(*) AS n, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'stale: ' || count(*) FILTER (o_orderstatus = 'P') || ' files changed since' END AS stale FROM orders")
def stale_mark(t):
    """An answer carries a mark only if files changed after its snapshot; silence means fresh."""
    answer = t.orders.agg(F.count(F.lit(1)).alias("n")).select(F.lit("snapshot 7").alias("answer_of"), "n")
    return incremental.with_stale_mark(answer, t.orders.where("o_orderstatus = 'P'").select("o_orderkey"))


@query("""WITH d AS (SELECT p_partkey, p_name, lower(p_name || ' ' || p_type) AS t FROM part), c AS (SELECT *, (length(t) - length(replace(t, 'ring', '')))::DOUBLE / 4 AS a, (length(t) - length(replace(t, 'small', '')))::DOUBLE / 5 AS b, greatest(length(t) - 2, 0)::DOUBLE AS len FROM d),
 s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS m, count(*) FILTER (a > 0)::DOUBLE AS da, count(*) FILTER (b > 0)::DOUBLE AS db FROM c)
 SELECT p_partkey, p_name, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / m)), 6) AS bm25 FROM c, s WHERE a > 0 AND b > 0""")
def substring_scores(t):
    """BM25 of phrases of trigrams over names and their synonyms."""
    found = search.substring_bm25(t.part, F.concat_ws(" ", "p_name", "p_type"), ["Ring", "small"])
    return found.select("p_partkey", "p_name", F.round("bm25", 6).alias("bm25"))


@query("""WITH w AS (SELECT user_id AS basket, user_id % 40 AS module, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS context, event_type AS s0, lead(event_type) OVER o AS s1, lead(event_type, 2) OVER o AS s2, row_number() OVER o AS rn FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id, event_type)),
 f AS (SELECT 'run1' AS family, context, s0 AS signature, module FROM w UNION ALL SELECT 'run2', context, s0 || ' > ' || s1, module FROM w WHERE s1 IS NOT NULL UNION ALL SELECT 'run3', context, s0 || ' > ' || s1 || ' > ' || s2, module FROM w WHERE s2 IS NOT NULL UNION ALL SELECT 'first', context, s0, module FROM w WHERE rn = 1),
 p AS (SELECT family, context, signature, count(*) AS observed, count(DISTINCT module) AS modules FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND count(DISTINCT module) >= 3)
 SELECT *, row_number() OVER (PARTITION BY family ORDER BY observed DESC, modules DESC, context, signature) AS rank FROM p QUALIFY rank <= 50""")
def fragment_profile(t):
    """Everything that recurs: runs of one to three symbols and first symbols, over users as baskets."""
    rows = t.events.withColumn("module", F.col("user_id") % 40)
    context = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return mining.profile(mining.fragments(rows, "module", "user_id", "event_type", "event_id", context), top=50)


@query("WITH " + USES_SQL + """, f AS (SELECT basket, symbol, min(pos) AS p, min(ctx) AS k FROM u GROUP BY 1, 2), p AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS observed, count(DISTINCT x.k) AS kinds FROM f x JOIN f y ON x.basket = y.basket AND x.p < y.p GROUP BY 1, 2)
 SELECT p.a, p.b, p.observed, coalesce(q.observed, 0) AS inverse, round(p.observed / (p.observed + coalesce(q.observed, 0)), 6) AS consistency FROM p LEFT JOIN p q ON q.a = p.b AND q.b = p.a WHERE p.observed >= 10 AND p.kinds >= 3 AND p.observed / (p.observed + coalesce(q.observed, 0)) >= 0.6""")
def order_in_three_categories(t):
    """Orders of first uses that hold in baskets of three categories or more."""
    found = mining.ordered_pairs(_uses(t), "basket", "symbol", "pos", consistency=0.6, category="ctx", categories=3)
    return found.withColumn("consistency", F.round("consistency", 6))


@query("WITH " + USES_SQL + """, v AS (SELECT basket, pos, CASE WHEN root IN ('P0', 'P1', 'P2') THEN symbol ELSE root END AS s FROM u), w AS (SELECT basket, s AS s0, lead(s) OVER o AS s1, lead(s, 2) OVER o AS s2 FROM v WINDOW o AS (PARTITION BY basket ORDER BY pos, s))
 SELECT s0 || ' > ' || s1 || ' > ' || s2 AS gram, count(DISTINCT basket) AS baskets FROM w WHERE s2 IS NOT NULL AND (s1 <> s0 OR s2 <> s0) AND (contains(s0, '.') OR contains(s1, '.') OR contains(s2, '.')) GROUP BY 1 HAVING count(DISTINCT basket) >= 10""")
def qualified_sequences(t):
    """Runs of three calls of which one at least is qualified by its root."""
    uses = _uses(t).withColumn("symbol", F.when(F.col("root").isin("P0", "P1", "P2"), F.col("symbol")).otherwise(F.col("root")))
    return mining.sequences(uses, "basket", "symbol", "pos", qualified=r"\.")


@query("SELECT p_partkey, p_name, p_brand FROM part ORDER BY lower(p_name) = 'small ring' DESC, lower(p_brand) = 'small ring' DESC, starts_with(lower(p_name), 'small ring') DESC, starts_with(lower(p_brand), 'small ring') DESC, length(p_name), p_partkey LIMIT 25")
def relevance_order(t):
    return t.part.select("p_partkey", "p_name", "p_brand").orderBy(*search.relevance_order(F.col("p_name"), F.col("p_brand"), "Small Ring"), "p_partkey").limit(25)


@query("WITH m AS (SELECT p_name AS name, count(l_orderkey) AS degree, p_size % 2 = 0 AS exported, p_brand || '/' || p_partkey AS path FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name, p_size, p_brand, p_partkey) SELECT lower(name) AS name_lc, name, degree, exported, path, count(*) OVER (PARTITION BY lower(name)) AS namesakes FROM m QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY degree DESC, exported DESC, length(path), path) = 1")
def most_called_namesake(t):
    uses = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.part.join(uses, F.col("l_partkey") == F.col("p_partkey"), "left")
    methods = rows.select(F.col("p_name").alias("name"), F.coalesce("n", F.lit(0)).alias("degree"), (F.col("p_size") % 2 == 0).alias("exported"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return relational.most_called(methods, "name", "degree", "exported", "path")


@query("WITH m AS (SELECT p_partkey, p_name, p_type, (contains(lower(p_name || ' ' || p_type), 'small'))::INT + (contains(lower(p_name || ' ' || p_type), 'ring'))::INT + (contains(lower(p_name || ' ' || p_type), 'econo'))::INT AS k, (contains(lower(p_name), 'small'))::INT + (contains(lower(p_name), 'ring'))::INT + (contains(lower(p_name), 'econo'))::INT AS h, (lower(p_name) = 'large bolt')::INT AS x, (lower(p_type) = 'economy')::INT AS o FROM part) SELECT p_partkey, p_name, x * 10000 + o * 2000 + k * 100 + h * 50 - length(p_name) AS rank_score FROM m WHERE k >= 2 OR x = 1")
def help_suggestions(t):
    found = search.suggest(t.part, "p_name", "p_type", ["small", "ring", "economy"], "Large Bolt", "Economy")
    return found.select("p_partkey", "p_name", "rank_score")


@query("WITH " + USES_SQL + """, d AS (SELECT ctx, count(DISTINCT basket) AS nd FROM u GROUP BY 1), s AS (SELECT symbol, count(DISTINCT basket) AS na FROM u GROUP BY 1), o AS (SELECT symbol, ctx, count(DISTINCT basket) AS o FROM u GROUP BY 1, 2)
 SELECT 'usage' AS mech, o.symbol AS a, o.ctx AS b, o.o AS evidence, CASE WHEN o.ctx = '5-LOW' THEN 's1' ELSE 's2' END AS snapshot, o.ctx = '5-LOW' AS outdated FROM o WHERE contains(lower(o.symbol || ' ' || o.ctx), 'p1') ORDER BY evidence DESC, a, b LIMIT 20""")
def practice_candidates(t):
    """Mined records that name a root, the strongest first; those of another snapshot are marked."""
    usage = mining.operator_usage(_uses(t), "basket", "symbol", "ctx").where("observed > 0")
    mined = usage.select(F.lit("usage").alias("mech"), F.col("symbol").alias("a"), F.col("directive").alias("b"), F.col("observed").alias("evidence"), F.when(F.col("directive") == "5-LOW", "s1").otherwise("s2").alias("snapshot"))
    return practices.candidates(mined, "usage", "P1", "s2", 20)
