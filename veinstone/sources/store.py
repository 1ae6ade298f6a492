"""Versioned Parquet tables: each change writes new folders, then one manifest makes them current.

The manifest is a small JSON file that is renamed into place, so readers see all tables of a commit or none.
Paths go through Hadoop's FileSystem, so the root may lie on any storage that the executors share. One
writer at a time; a commit that finds a newer manifest than it started from fails instead of overwriting.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from veinstone.functions.schema import TABLES


class StaleVersion(RuntimeError):
    """Another commit came first."""


class Store:
    """Tables under root; reads resolve the manifest that was current when the call was made."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str]]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted((int(n[:-5]), n) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """Number of the current commit, 0 if there is none."""
        return max((v for v, _ in self._manifests()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def initialised(self) -> bool:
        return self.version() > 0

    def init(self, rebuild: bool = False) -> int:
        """Empty tables of the catalogue; those that exist stay unless rebuild is set."""
        have = {} if rebuild else self._manifest(self.version())
        missing = {t: self.spark.createDataFrame([], ddl) for t, ddl in TABLES.items() if t not in have}
        return self.commit(missing) if missing else self.version()

    def tables(self) -> list[str]:
        return sorted(self._manifest(self.version()))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the current one."""
        manifest = self._manifest(self.version() if version is None else version)
        if table not in manifest:
            raise FileNotFoundError(f"no table {table} under {self.root}")
        frame = self.spark.read
        return (frame.schema(TABLES[table]) if table in TABLES else frame).parquet(f"{self.root}/{manifest[table]}")

    def commit(self, changes: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes the tables and makes them current together; returns the new version."""
        start = self.version() if base is None else base
        manifest = self._manifest(start)
        for table, df in changes.items():
            place = f"data/{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{place}")
            manifest[table] = place
        folder = self._path(f"{self.root}/manifests")
        self._fs.mkdirs(folder)
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        target = self._path(f"{self.root}/manifests/{start + 1}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise StaleVersion(f"version {start + 1} exists")
        return start + 1

    def vacuum(self, keep: int = 1) -> int:
        """Drops folders that none of the last keep versions uses; returns how many."""
        versions = [v for v, _ in self._manifests()]
        used = {p for v in versions[-keep:] for p in self._manifest(v).values()}
        dropped = 0
        for v in versions[:-keep]:
            for place in self._manifest(v).values():
                path = self._path(f"{self.root}/{place}")
                if place not in used and self._fs.exists(path):
                    self._fs.delete(path, True)
                    dropped += 1
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)
        return dropped


@contextmanager
def opened(spark: SparkSession, root: str) -> Iterator[Store]:
    """A store for the time of a block; the root must exist."""
    store = Store(spark, root)
    if not store._fs.exists(store._path(store.root)):
        raise FileNotFoundError(store.root)
    yield store


def config_value(store: Store, key: str, default: str | None = None) -> str | None:
    """The latest value of a key of the table config."""
    from pyspark.sql import functions as F

    row = store.read("config").filter(F.col("key") == key).orderBy(F.col("updated_at").desc_nulls_last()).limit(1).head()
    return default if row is None else row.value
