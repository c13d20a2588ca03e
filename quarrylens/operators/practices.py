"""Rules of a project: conflicts by authority, validation by evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Who outranks whom (fixed values).
AUTHORITY = {"customer": 4, "project": 3, "standard": 2, "observed": 1}


def authority_rank(column):
    out = F.lit(0)
    for name, rank in AUTHORITY.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def resolve_conflicts(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (id, topic, authority) that stand, and those that a rule of higher authority on the topic displaces."""
    ranked = rules.withColumn("rank", authority_rank(F.col("authority")))
    top = ranked.groupBy("topic").agg(F.max("rank").alias("top"))
    joined = ranked.join(top, "topic")
    stand = joined.where("rank = top").drop("rank", "top")
    return stand, joined.where("rank < top").drop("rank", "top")


def validate(rules: DataFrame, evidence: DataFrame, addresses: DataFrame, sample: int = 10, precision: float = 0.9) -> DataFrame:
    """Rules (id, sample, matches) with verified: sample and precision suffice and every address of their evidence exists."""
    known = addresses.select(F.col(addresses.columns[0]).alias("__a")).distinct()
    checked = evidence.join(known, F.col("address") == F.col("__a"), "left").groupBy("id").agg(F.count_if(F.col("__a").isNull()).alias("missing"), F.count(F.lit(1)).alias("shown"))
    ok = (F.col("sample") >= sample) & (F.col("matches") >= precision * F.col("sample")) & (F.coalesce("missing", F.lit(1)) == 0) & (F.coalesce("shown", F.lit(0)) > 0)
    return rules.join(checked, "id", "left").withColumn("verified", ok).drop("missing", "shown")


def candidates(mined: DataFrame, mech: str | None = None, contains: str | None = None, snapshot: str | None = None, limit: int = 50) -> DataFrame:
    """Mined records (mech, a, b, evidence, snapshot) by mechanism and text, strongest first, with ``outdated`` where another snapshot is current."""
    rows = mined if mech is None else mined.where(F.col("mech") == mech)
    if contains:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "a", "b")), F.lit(contains.lower())))
    rows = rows.withColumn("outdated", F.lit(snapshot).isNotNull() & ~F.col("snapshot").eqNullSafe(F.lit(snapshot)))
    return rows.orderBy(F.desc("evidence"), "mech", "a", "b").limit(min(max(limit, 1), 500))
