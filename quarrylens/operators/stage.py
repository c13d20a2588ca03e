"""Cutting lineage in loops, and dealing rows to tasks by the size of the input."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that ``spark.checkpoint.dir`` names; on a single machine without that setting, in a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrylens-"))
    return df.checkpoint()


def tasks(*frames: DataFrame, kb: int = 64, mb: int = 4) -> int:
    """Tasks to deal the rows of ``frames`` to: one for ``kb`` KB of the files that they read, up to the session's shuffle partitions, and from
    ``mb`` MB a task on as many as there are such pieces, so that a task's share does not grow with the input.  Without a known size, the session's.
    """
    session = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 0
    for frame in frames:
        leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size >= 1 << 60:  # what Spark takes for unknown
        return session
    return max(1, min(session, math.ceil(size / (kb << 10))), math.ceil(size / (mb << 20)))


def dealt(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks``; adaptive execution does not put these together again, and what groups or joins by the keys afterwards stays in its task."""
    return df.repartition(n or tasks(df), *keys)
