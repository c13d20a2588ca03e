"""Upkeep: upserts by module, freshness, and a stream of changed files that moves its baseline only on success."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


class Refused(RuntimeError):
    """The batch cannot be applied step by step; it stays queued for a full build."""


def upsert(old: DataFrame, new: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """Rows of touched keys are replaced by the new rows; keys touched without new rows are deleted."""
    keys = (touched if touched is not None else new).select(F.col(key).alias("__k")).distinct()
    return old.join(keys, F.col(key) == F.col("__k"), "left_anti").unionByName(new)


def upsert_report(old: DataFrame, new: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """(added, replaced, removed) keys."""
    o, n, t = (d.select(key).distinct() for d in (old, new, touched))
    flags = t.join(o.withColumn("in_old", F.lit(True)), key, "left").join(n.withColumn("in_new", F.lit(True)), key, "left")
    return flags.agg(
        F.count_if(F.col("in_old").isNull() & F.col("in_new").isNotNull()).alias("added"), F.count_if(F.col("in_old").isNotNull() & F.col("in_new").isNotNull()).alias("replaced"), F.count_if(F.col("in_old").isNotNull() & F.col("in_new").isNull()).alias("removed")
    )


def stale_edges(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Unresolved calls whose name the touched methods define."""
    names = methods.select(F.lower("name").alias("__n")).distinct()
    return calls.where(F.col("callee_key").isNull()).join(names, F.lower("callee_name") == F.col("__n"), "left_semi")


def sync_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): added, updated, unchanged or removed, by content hash, in one pass."""
    o = old.select(F.col(key).alias("ok"), F.col(digest).alias("od"))
    n = new.select(F.col(key).alias("nk"), F.col(digest).alias("nd"))
    state = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").when(F.col("od") == F.col("nd"), "unchanged").otherwise("updated")
    return o.join(n, F.col("ok") == F.col("nk"), "full").select(F.coalesce("nk", "ok").alias(key), state.alias("state"))


def freshness(files: DataFrame, built_at: float, grace_s: int = 1, examples: int = 3) -> DataFrame:
    """(changed, examples, stale) from (path, modificationTime): files newer than the build."""
    newer = files.where(F.col("modificationTime").cast("timestamp").cast("double") > built_at + grace_s)
    first = newer.orderBy("path").limit(examples).agg(F.sort_array(F.collect_list("path")).alias("examples"))
    return newer.agg(F.count(F.lit(1)).alias("changed")).crossJoin(F.broadcast(first)).withColumn("stale", F.col("changed") > 0)


def poll_interval_ms(n_files: int) -> int:
    """5 s, and 1 s more for every 500 files, 60 s at most."""
    return min(5000 + 1000 * (n_files // 500), 60_000)


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, n_files: int = 0, once: bool = True) -> DataStreamWriter:
    """Feed changed files to ``apply`` batch by batch.

    A batch that holds anything but modules raises ``Refused`` and is not committed, so the next start sees it
    again; ``apply`` must give the same result when a batch is repeated (name its snapshot by the batch id).
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.where(F.lower("path").endswith(".xml")).limit(1).count():
            raise Refused("metadata changed: a full build is needed")
        apply(batch, batch_id)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{poll_interval_ms(n_files)} milliseconds")


def file_stream(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """New files under ``root`` as (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)


def vanished(known: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """Known files that a listing no longer shows: a file stream never tells of deletions."""
    return known.select(key).join(listed.select(F.col(key).alias("__l")), F.col(key) == F.col("__l"), "left_anti")


def with_stale_mark(answer: DataFrame, changed: DataFrame) -> DataFrame:
    """``answer`` with ``stale``: how many files changed since its snapshot; null, and so silent, if none did."""
    n = F.col("__n")
    mark = changed.agg(F.count(F.lit(1)).alias("__n")).select(F.when(n > 0, F.concat(F.lit("stale: "), n.cast("string"), F.lit(" files changed since"))).alias("stale"))
    return answer.crossJoin(F.broadcast(mark))  # one row
