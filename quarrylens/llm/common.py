"""Tables, shared scratch space and keys used by every operator of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that pass to a Python worker at once (one row more at most), on the way there and in its hands.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a single machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_open: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quarrylens/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end; what is to outlive it is written to a path made before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, whatever executors are lost later."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` for an aggregated ``right``: joined on the key and its hash, both sides are dealt anew.

    Without that, an aggregate that is already dealt by the key keeps its place, and Spark cannot split a hot key of the other side.
    """
    marked = right.withColumnRenamed(key, "__key")
    return left.join(marked, (F.xxhash64(key) == F.xxhash64("__key")) & (F.col(key) == F.col("__key")), how).drop("__key")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_BYTES``, which the session keeps as its setting unless it has a smaller one.

    Spark's own bound is 64 MB or 10,000 rows.  A batch of that size lies outside the heap of the executor, where its vectors double
    as they grow, and again in the worker; neither gives all of it back.
    """
    spark = df.sparkSession
    if spark._jconf.arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system (any store)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def crc_of_id(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))
