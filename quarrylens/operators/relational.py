"""Joins and picks over structured metadata: every function takes and returns DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import dealt, tasks


def innermost_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, point_id: str, name: str) -> DataFrame:
    """Each point with the innermost interval of its key that covers it (start <= at <= end, an open end covers all); none: null.

    ``intervals``: (key, start, end, name).  A key's intervals are gathered and meet its points in one join on the key; ``point_id`` stands first, as it names the row.
    """
    n = tasks(points, intervals)
    ends = F.struct(F.col("start").alias("s"), F.negative(F.coalesce("end", F.lit(2**62))).alias("e"), F.col(name).alias("n"))
    i = dealt(intervals.select(F.col(key).alias("__k"), ends.alias("i")), "__k", n=n).groupBy("__k").agg(F.collect_list("i").alias("__i"))
    rest = [c for c in points.columns if c != point_id]
    found = dealt(points, key, n=n).join(i, F.col(key) == F.col("__k"), "left")
    over = F.filter("__i", lambda x: (x["s"] <= F.col(at)) & (-x["e"] >= F.col(at)))
    return found.select(point_id, *rest, F.array_max(over)["n"].alias(name))


def top_level(intervals: DataFrame, key: str) -> DataFrame:
    """Intervals that begin after every earlier one of their key has ended."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("__m", F.max("end").over(before)).where(F.col("__m").isNull() | (F.col("__m") < F.col("start"))).drop("__m")


def base_wins(base: DataFrame, extension: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows, and extension rows whose key, without regard to case, is new."""
    own = [F.lower(F.col(k).cast("string")).alias(f"__k{i}") for i, k in enumerate(keys)]
    known = base.select(*own).distinct()
    on = [F.lower(F.col(k).cast("string")) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    return base.unionByName(extension.join(known, reduce(Column.__and__, on), "left_anti"))


def existing_only(usages: DataFrame, registry: DataFrame, usage_key: str, registry_key: str) -> DataFrame:
    """Usages of objects in the registry; an empty registry filters nothing."""
    known = registry.select(F.lower(F.col(registry_key).cast("string")).alias("__r")).distinct()
    filtered = usages.join(known, F.lower(F.col(usage_key).cast("string")) == F.col("__r"), "left_semi")
    return filtered if known.limit(1).count() else usages


def home_group(content: DataFrame, member: str, group: str) -> DataFrame:
    """Each member's smallest group (ties by name), with the group's size."""
    sized = content.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(group)))
    first = Window.partitionBy(member).orderBy("group_size", group)
    return sized.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def resolve_override(overrides: DataFrame, methods: DataFrame) -> DataFrame:
    """Overrides (module, method) with the first line of the method they mean, or null: unresolved ones stay."""
    m = methods.groupBy(F.lower("module").alias("__m"), F.lower("name").alias("__n")).agg(F.min("line").alias("target_line"))
    return overrides.join(m, (F.lower("module") == F.col("__m")) & (F.lower("method") == F.col("__n")), "left").drop("__m", "__n")


def union_references(parts: list[DataFrame]) -> DataFrame:
    """One table of typed references from several derivations."""
    return reduce(DataFrame.unionByName, parts)


def collapse_namesakes(candidates: DataFrame, signals: list[str]) -> DataFrame:
    """One row for each (kind, name without case): the best of each signal, the payload of the highest degree, and how many places more there are."""
    best = F.struct("degree", F.col("payload"))
    return candidates.groupBy("kind", F.lower("name").alias("name_lc")).agg(
        F.max_by("name", best).alias("name"), F.max_by("payload", best).alias("payload"), *[F.max(s).alias(s) for s in signals], (F.count_distinct("payload") - 1).alias("others")
    )


def page(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One page of an ordered table, and (total, has_more, next_offset)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    more = total.select("total", (F.col("total") > offset + limit).alias("has_more"), F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")).alias("next_offset"))
    return df.orderBy(*order).offset(offset).limit(limit), more


def clamp(value: int | None, default: int, most: int) -> int:
    return min(max(default if value is None else value, 1), most)


def to_envelope(df: DataFrame, limit: int = 200) -> dict:
    """The first rows as {columns, rows, count, truncated}; trailing nulls of a row are left out."""
    rows = df.limit(limit + 1).collect()
    out = []
    for r in rows[:limit]:
        values = list(r)
        while values and values[-1] is None:
            values.pop()
        out.append(values)
    return {"columns": df.columns, "rows": out, "count": len(out), "truncated": len(rows) > limit}


def ring_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` (name, cluster, weight) with ``place`` on a ring: by cluster, weight descending, name.

    Places are an offset of the cluster and a rank inside it, so that clusters are ranked apart.
    """
    sizes = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"))  # few rows
    ahead = sizes.alias("x").join(F.broadcast(sizes.alias("y")), F.col("y.cluster") < F.col("x.cluster"), "left").groupBy("x.cluster").agg(F.coalesce(F.sum("y.__n"), F.lit(0)).alias("__ahead"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "name"))
    return nodes.withColumn("__r", rank).join(F.broadcast(ahead), "cluster").select("name", "cluster", "weight", (F.col("__r") + F.col("__ahead")).cast("long").alias("place"))


def two_stage_top(hits: DataFrame, order: list[Column], first: int, keep: Column, dedupe: str, n: int) -> DataFrame:
    """The ``first`` best hits; of those that pass ``keep`` the best of each ``dedupe`` value; the ``n`` best of these."""
    best = hits.orderBy(*order).limit(first).where(keep)  # a top-k on every task, then at most ``first`` rows
    one = best.withColumn("__k", F.row_number().over(Window.partitionBy(dedupe).orderBy(*order))).where("__k = 1").drop("__k")
    return one.orderBy(*order).limit(n)


def cut_across(rows: DataFrame, name: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows over all names with their place ``n`` and the full count ``of_name`` of their name."""
    counts = rows.groupBy(F.col(name).alias("__name")).agg(F.count(F.lit(1)).alias("of_name"))
    top = rows.orderBy(*order).limit(n)
    placed = top.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows
    return placed.join(counts, F.col(name) == F.col("__name")).drop("__name")


def most_called(methods: DataFrame, name: str, degree: str, export: str, path: str) -> DataFrame:
    """One row for each name without case: the namesake with most callers, then exported, then with the shortest and first path."""
    rank = F.struct(F.negative(degree).alias("d"), F.negative(F.col(export).cast("int")).alias("e"), F.length(path).alias("l"), F.col(path).alias("p"))
    return methods.groupBy(F.lower(name).alias("name_lc")).agg(F.min_by(F.struct(*methods.columns), rank).alias("__m"), F.count(F.lit(1)).alias("namesakes")).select("name_lc", "__m.*", "namesakes")
