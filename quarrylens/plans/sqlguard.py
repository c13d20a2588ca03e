"""Read-only SQL over registered views: Spark parses the text, and what the parsed plan holds decides.

A plan passes if each of its nodes is one of ``NODES``, each table a view registered under one plain name, and each
function one of ``FUNCTIONS``.  Commands, paths (``parquet.`/x```), catalogs, table functions that read, and calls into
the JVM are none of these.  CTEs and subqueries are walked as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes that only compute.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort Limit GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except SubqueryAlias Subquery Sample Pivot Unpivot Generate Window WithWindowDefinition "
    "UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable UnresolvedTableValuedFunction OneRowRelation LocalRelation CTERelationRef WithCTE CTERelationDef UnresolvedTVFAliases".split()
)
#: Functions of values, aggregates, windows and generators.
FUNCTIONS = frozenset(
    "abs any approx_count_distinct array array_agg array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_sort array_union arrays_overlap ascii avg "
    "bit_count cast ceil ceiling char char_length character_length chr coalesce collect_list collect_set concat concat_ws contains count count_if crc32 cume_dist "
    "date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exists exp explode explode_outer extract filter first first_value flatten floor format_number from_unixtime "
    "get get_json_object greatest grouping grouping_id hash hour if ifnull in initcap instr isnan isnotnull isnull lag last last_value lcase lead least left len length levenshtein ln locate log log10 log2 lower lpad ltrim "
    "map map_keys map_values max max_by md5 mean median min min_by minute mod month months_between named_struct nth_value ntile nullif nvl nvl2 octet_length percent_rank percentile pmod posexplode position pow power quarter range rank regexp regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rlike round row_number rpad rtrim "
    "second sequence sha sha1 sha2 sign signum size slice sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp struct substr substring substring_index sum to_date to_timestamp transform translate trim trunc try_cast typeof ucase unix_timestamp upper var_pop var_samp variance when window xxhash64 year".split()
)


class Rejected(ValueError):
    """The query is not a single read-only statement over registered views."""


def _items(sequence) -> Iterator:
    for i in range(sequence.length()):
        yield sequence.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(node) -> None:
    kind = _kind(node)
    if kind == "UnresolvedFunction":
        name = ".".join(_items(node.nameParts())).lower()
        if name not in FUNCTIONS:
            raise Rejected(f"the function {name} is not allowed")
    for child in _items(node.children()):
        _check_expression(child)
    if "plan" in kind.lower() or kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery", "UnresolvedScalarSubquery"):
        plan = getattr(node, "plan", None)
        if plan is not None and kind != "InSubquery":
            _check(plan())


def _check(plan) -> None:
    kind = _kind(plan)
    if kind not in NODES:
        raise Rejected(f"{kind} is not allowed: only SELECT over registered views")
    if kind == "UnresolvedRelation" and plan.multipartIdentifier().length() != 1:
        raise Rejected("only registered views are allowed, by their plain names")
    if kind == "UnresolvedTableValuedFunction":
        name = ".".join(_items(plan.name())).lower()
        if name not in FUNCTIONS:
            raise Rejected(f"the table function {name} is not allowed")
    for expression in _items(plan.expressions()):
        _check_expression(expression)
    if kind == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            _check(pair._2())
    for child in _items(plan.children()):
        _check(child)


def validate(spark: SparkSession, query: str) -> str:
    """The statement to run, or Rejected."""
    statement = query.strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:  # whatever the parser raises through the gateway
        raise Rejected(str(e).splitlines()[0]) from None
    _check(plan)
    return statement


def hint(spark: SparkSession, query: str, error: str) -> str:
    """The error, with the columns of the tables that the query names, or tables with similar names."""
    tables = {t.name.lower(): t.name for t in spark.catalog.listTables()}
    named = [tables[w] for w in re.findall(r"[a-z_][a-z0-9_]*", query.lower()) if w in tables]
    if named:
        lines = [f"{t}: {', '.join(c.name for c in spark.catalog.listColumns(t))}" for t in dict.fromkeys(named)]
        return f"{error}\ncolumns: " + "; ".join(lines)
    wanted = re.findall(r"(?i)\b(?:from|join)\s+([a-z_][a-z0-9_]*)", query)
    close = sorted(tables.values(), key=lambda t: -max((len(set(t.lower()) & set(w.lower())) for w in wanted), default=0))
    return f"{error}\ntables: " + ", ".join(close[:5])


def run(spark: SparkSession, query: str, limit: int = 200) -> DataFrame:
    """The query's first ``limit`` rows (clamped to 2000)."""
    statement = validate(spark, query)
    try:
        return spark.sql(statement.rstrip("; \n\t")).limit(min(max(limit, 1), 2000))
    except (AnalysisException, ParseException) as e:
        raise Rejected(hint(spark, statement, str(e).splitlines()[0])) from e


def schema(spark: SparkSession) -> list[tuple[str, str, str]]:
    """(table, column, type) of every registered view."""
    return [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
