"""Snapshots: one folder of Parquet tables for each build, and a pointer to the current one."""

from __future__ import annotations

import contextlib
import json
import threading
import time
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Tables that ``Store.kept`` holds in memory at once, the least recently used goes first.
KEEP = 4
_kept: dict[tuple[str, str | None, str], DataFrame] = {}
SCHEMA_VERSION = 7
MIN_READABLE = 1


class Store:
    """Tables under ``root``; works on any file system that Spark reaches, through Hadoop's API."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def _replace(self, name: str, content: str) -> None:
        """Write beside, then rename over it in one step: readers see the old or the new file, never none."""
        new, old = self._path(f"{self.root}/{name}.new"), self._path(f"{self.root}/{name}")
        out = self._fs.create(new, True)
        out.write(bytearray(content.encode()))
        out.close()
        self._rename(new, old)

    def _rename(self, source, target) -> None:
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, over)

    def current(self) -> dict | None:
        found = self._read("CURRENT")
        return json.loads(found) if found else None

    def write(self, tables: dict[str, DataFrame], meta: dict | None = None, snapshot: str | None = None) -> str:
        """All tables, then the pointer: a build that fails half-way leaves the old snapshot in place."""
        name = snapshot or f"snapshot={int(time.time() * 1000)}"
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/{table}")
        self._replace("CURRENT", json.dumps({"snapshot": name, "schema_version": SCHEMA_VERSION, "built_at": int(time.time()), "tables": sorted(tables)} | (meta or {})))
        return name

    def has(self, table: str) -> bool:
        now = self.current()
        return bool(now) and table in now["tables"]

    def read(self, table: str) -> DataFrame:
        """A table of the current snapshot.  A missing one is an error: empty would say that there is nothing."""
        now = self.current()
        if not now or table not in now["tables"]:
            raise KeyError(f"{table} is not in the snapshot")
        if now["schema_version"] < MIN_READABLE:
            raise ValueError(f"schema version {now['schema_version']} is too old")
        return self.spark.read.parquet(f"{self.root}/{now['snapshot']}/{table}")

    def register(self) -> None:
        for table in (self.current() or {"tables": []})["tables"]:
            self.read(table).createOrReplaceTempView(table)

    def kept(self, table: str) -> DataFrame:
        """A table of the current snapshot, kept in memory until another snapshot is current or more than ``KEEP`` tables are kept."""
        key = (self.root, (self.current() or {}).get("snapshot"), table)
        if key not in _kept:
            for old in [k for k in _kept if k[0] == self.root and k[1] != key[1]] + list(_kept)[: max(0, len(_kept) - KEEP + 1)]:
                if old in _kept:
                    _kept.pop(old).unpersist()
            _kept[key] = self.read(table).persist(StorageLevel.MEMORY_AND_DISK)
        _kept[key] = _kept.pop(key)  # the last one used goes last
        return _kept[key]

    def sidecar(self, name: str, df: DataFrame) -> str:
        """``df`` as JSON lines beside the snapshots, whole or not at all: written under another name, then swapped in by a pointer file."""
        folder = f"{name}-{time.time_ns()}"
        df.write.json(f"{self.root}/{folder}")
        self._replace(f"{name}.current", folder)
        return f"{self.root}/{folder}"

    def read_sidecar(self, name: str, schema: str) -> DataFrame | None:
        folder = self._read(f"{name}.current")
        return self.spark.read.schema(schema).json(f"{self.root}/{folder}") if folder else None

    def count(self, table: str) -> int:
        """Rows of a table, -1 where it is absent."""
        return self.read(table).count() if self.has(table) else -1

    def _create(self, path) -> bool:
        """Make the marker; False if it is there already (one of several that try wins)."""
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if self._fs.exists(path):
                return False
            raise e
        out.write(bytearray(str(time.time()).encode()))
        out.close()
        return True

    def lock(self, stale_s: int = 20) -> bool:
        """Take the build marker; a marker whose heartbeat is older than ``stale_s`` seconds is taken over."""
        p = self._path(f"{self.root}/BUILDING")
        if self._create(p):
            return True
        with contextlib.suppress(Py4JJavaError):  # it may go meanwhile
            if time.time() * 1000 - self._fs.getFileStatus(p).getModificationTime() <= stale_s * 1000:
                return False
            # of several that find it stale, one moves it away
            self._fs.rename(p, self._path(f"{self.root}/BUILDING.{time.time_ns()}"))
        return self._create(p)

    def beat(self) -> None:
        self._fs.setTimes(self._path(f"{self.root}/BUILDING"), int(time.time() * 1000), -1)

    @contextlib.contextmanager
    def building(self, every_s: float = 5.0, stale_s: int = 20) -> Iterator[None]:
        """Hold the build marker and keep it fresh for as long as the build takes."""
        if not self.lock(stale_s):
            raise RuntimeError("another build is running")
        done = threading.Event()

        def run() -> None:
            while not done.wait(every_s):
                self.beat()

        beats = threading.Thread(target=run, daemon=True)
        beats.start()
        try:
            yield
        finally:
            done.set()
            beats.join()
            self.unlock()

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/BUILDING"), False)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)
