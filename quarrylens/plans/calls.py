"""Calls, their arguments and literals on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining
from ..sources import events
from .registry import query


@query("""WITH e(pos, line, name, flags, try_id, first_kind, args, concat, parent) AS (VALUES
  (0, 3, 'Tools.Is', 'CT', 1, 'E', 'I:size|=true', false, ''), (1, 4, '*.Say', 'BT', 1, 'E', 'E|E', false, ''), (2, 4, 'param:Item.Name', 'BT', 1, '-', '', true, '*.Say'),
  (3, 4, 'Новый Box', 'BT', 1, 'N', 'N', false, '*.Say'), (4, 7, 'ВызватьИсключение', 'X', 1, 'E', '', false, ''))
 SELECT 'P' || p_partkey AS method, pos, line, name, flags, try_id, first_kind, args, concat, parent FROM part, e""")
def call_events(t):
    """Calls with blocks, arguments, joins and surrounding calls of one module for each part."""
    key = F.col("p_partkey").cast("string")
    code = ["Procedure P", key, '(Val Item, Other) Export\n  Try\n    If Tools.Is(Item.Size, true) Then // a note "\n      Else_.Say("a ""b" + Item.Name(), New Box(', F.col("p_size").cast("string"), '));\n    EndIf;\n  Except\n    Raise("b");\n  EndTry;\nEndProcedure\n']
    modules = t.part.select(F.concat(F.lit("m/"), key).alias("rel_path"), F.concat(*[F.lit(c) if isinstance(c, str) else c for c in code]).alias("content"))
    known = t.spark.createDataFrame([("tools",)], "name string")
    found = events.named(events.events(modules), known)
    args = F.array_join(F.transform("args", events.described), "|")
    parent = F.when(F.col("parent") == "Else_.Say", "*.Say").otherwise(F.col("parent"))
    return found.select("method", "pos", F.col("line").cast("int").alias("line"), "name", "flags", "try_id", "first_kind", args.alias("args"), "concat", parent.alias("parent"))



def _mode():
    """A third key of a line."""
    return F.concat(F.lit("K"), (F.col("l_partkey") % 7).cast("string"))


FORMS_SQL = """u AS (SELECT 'F' || l_linenumber AS symbol, 1 AS place, CASE WHEN l_linenumber <= 2 THEN 'I:name' WHEN l_linenumber <= 4 THEN 'I:' || lower('K' || (l_partkey % 7)) WHEN l_linenumber = 5 THEN 'S:a~' || 'K' || (l_partkey % 7) || '|k=x' ELSE 'N' END AS form FROM lineitem
 UNION ALL SELECT 'F' || l_linenumber, 2, CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'E' ELSE 'C:' || l_linestatus END FROM lineitem)"""


@query("WITH " + FORMS_SQL + """, c AS (SELECT symbol, place, CASE WHEN starts_with(form, 'S:') THEN split_part(form, '~', 1) WHEN left(form, 2) IN ('C:', 'I:') OR form[1] = '=' THEN form ELSE form[1] END AS v FROM u),
 n AS (SELECT symbol, place, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 30),
 a AS (SELECT symbol, place, v AS value, count(*) / any_value(n) AS share, any_value(n) AS n FROM c JOIN n USING (symbol, place) WHERE v NOT IN ('-', 'N', 'E') GROUP BY ALL HAVING count(*) >= 0.95 * any_value(n.n)),
 b AS (SELECT symbol, place, left(v, 2) AS value, count(*) / any_value(n) AS share, any_value(n) AS n FROM c JOIN n USING (symbol, place) WHERE left(v, 2) IN ('S:', 'I:', 'C:') GROUP BY ALL HAVING count(*) >= 0.95 * any_value(n.n))
 SELECT symbol, place, value, round(share, 6) AS share, n FROM a UNION ALL SELECT symbol, place, value, round(share, 6), n FROM b ANTI JOIN a USING (symbol, place)""")
def argument_forms(t):
    line = F.col("l_linenumber")
    one = F.when(line <= 2, "I:name").when(line <= 4, F.concat(F.lit("I:"), F.lower(_mode()))).when(line == 5, F.concat(F.lit("S:a~"), _mode(), F.lit("|k=x"))).otherwise("N")
    two = F.when((F.col("l_returnflag") == "R") & (line % 2 == 0), "E").otherwise(F.concat(F.lit("C:"), "l_linestatus"))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), c.alias("form")) for i, c in ((1, one), (2, two))]))
    uses = t.lineitem.select(F.concat(F.lit("F"), line.cast("string")).alias("symbol"), places.alias("p")).select("symbol", "p.*")
    return mining.argument_forms(uses, "symbol", "place", "form").withColumn("share", F.round("share", 6))


@query("""WITH l AS (SELECT l_linenumber AS s, CASE WHEN l_linenumber = 1 AND l_partkey % 7 = 3 THEN [l_returnflag, l_linestatus] ELSE [l_returnflag, l_linestatus, 'K' || (l_partkey % 7)] END AS keys FROM lineitem),
 t AS (SELECT s, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 100), u AS (SELECT s, key, count(*) AS o FROM (SELECT s, unnest(keys) AS key FROM l) GROUP BY ALL),
 v AS (SELECT s, list(key) AS vk FROM u JOIN t USING (s) WHERE o >= 0.01 * n GROUP BY 1), r AS (SELECT v.s, l.keys FROM v JOIN l ON l.s <> v.s AND list_has_any(l.keys, v.vk)),
 a AS (SELECT s, count(*) AS related FROM r GROUP BY 1 HAVING count(*) >= 100), k AS (SELECT s, key, count(*) AS c FROM (SELECT s, unnest(keys) AS key FROM r) GROUP BY ALL HAVING count(*) >= 30)
 SELECT 'F' || k.s AS symbol, k.key, 0::BIGINT AS observed, round(n * c / related, 6) AS expected, n, related FROM k JOIN v USING (s) JOIN t USING (s) JOIN a USING (s)
 ANTI JOIN u ON u.s = k.s AND u.key = k.key WHERE NOT list_contains(vk, k.key) AND n * c / related >= 6.91""")
def avoided_keys(t):
    """Keys that the literals of other symbols hold beside the same keys, and those of one symbol never."""
    absent = (F.col("l_linenumber") == 1) & (F.col("l_partkey") % 7 == 3)
    keys = F.when(absent, F.array("l_returnflag", "l_linestatus")).otherwise(F.array("l_returnflag", "l_linestatus", _mode()))
    literals = t.lineitem.select(F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("symbol"), F.lit(1).alias("place"), keys.alias("keys"))
    found = mining.avoided_keys(literals, "symbol", "place", "keys").where("observed = 0 AND expected >= 6.91")
    return found.select("symbol", "key", "observed", F.round("expected", 6).alias("expected"), "n", "related")


@query("""WITH p AS (SELECT event_type AS s, CASE WHEN user_id % 10 < 4 THEN 'early' WHEN user_id % 10 < 6 THEN 'late' ELSE '' END AS p, count(*) AS k, count(*) FILTER (user_id % 20 = 0) AS c FROM events GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k DESC, p) AS i FROM p)
 SELECT s AS symbol, round(sum(c) / sum(k), 6) AS concat_share, string_agg(p, ',' ORDER BY i) FILTER (i <= 4 AND p <> '') AS parents, sum(k)::BIGINT AS n FROM r GROUP BY 1
 HAVING sum(k) >= 100 AND sum(c) <= 0.1 * sum(k) AND sum(k) FILTER (i <= 4 AND p <> '') >= 0.2 * sum(k)""")
def never_joined(t):
    u = F.col("user_id")
    rows = t.events.select("event_type", F.when(u % 10 < 4, "early").when(u % 10 < 6, "late").alias("parent"), (u % 20 == 0).alias("joined"))
    found = mining.never_joined(rows, "event_type", "parent", "joined")
    return found.select("symbol", F.round("concat_share", 6).alias("concat_share"), F.array_join(F.transform("parents", lambda x: x["parent"]), ",").alias("parents"), "n")


@query("""WITH b AS (SELECT p_partkey, p_brand || ' = ''' || p_name || ''', Размер =' || p_size || ' "x' AS body FROM part),
 c AS (SELECT *, left(regexp_replace(regexp_replace(regexp_replace(body, '[A-Za-zА-Яа-яЁё]+', 'a', 'g'), '[0-9]+', '9', 'g'), '[ ]+', ' ', 'g'), 40) AS shape,
  regexp_replace(regexp_replace(body, '''[^'']*''?', '''…''', 'g'), '[A-Za-zА-Яа-яЁё_][0-9A-Za-zА-Яа-яЁё_]*', 'a', 'g') AS names FROM b)
 SELECT p_partkey, 'S:' || left(regexp_replace(regexp_replace(regexp_replace(names, '[0-9]+', '9', 'g'), '[ ]+', '', 'g'), 'a(a)+', 'a', 'g'), 24) || '~' || shape || CASE WHEN regexp_matches(body, '[A-Za-zА-Яа-яЁё]+ *= ''') THEN '|k=' || regexp_extract(body, '([A-Za-z]+) *= ', 1) || ',Размер' ELSE '|k=Размер' END AS description FROM c""")
def literal_descriptions(t):
    """All quotes at the ends go, also those that belong to the text."""
    body = F.concat(F.lit('"'), "p_brand", F.lit(" = '"), "p_name", F.lit("', Размер ="), F.col("p_size").cast("string"), F.lit(' ""x"""'))
    return t.part.select("p_partkey", T.literal_description(body).alias("description"))
