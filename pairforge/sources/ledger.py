"""A table of finished work that grows by whole commits: parquet folders, and numbered snapshots that list those that count.

A commit writes its rows to a folder of its own and then puts the next snapshot in place, in one rename that fails if another writer was first. Until then nobody reads
the folder, so a run that breaks off leaves nothing behind that counts. The loser of a race looks at what the winner added, drops the rows whose keys are there by now and tries
again; so does a run that is repeated. Files go through Spark's file systems, so a ledger may lie wherever Spark writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """Rows with a unique key set: a key is what keys say, and may have several rows of one commit."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last snapshot; 0 before the first commit."""
        folder = self._at(f"{self.path}/snapshots")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.partition(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def folders(self, version: int | None = None) -> list[str]:
        """The folders that a snapshot, the last one by default, lists."""
        n = self.version() if version is None else version
        if not n:
            return []
        stream = self._fs.open(self._at(f"{self.path}/snapshots/{n}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a snapshot; None if nothing was committed yet."""
        folders = self.folders(version)
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def _put(self, n: int, folders: list[str]) -> bool:
        """Snapshot n, whole and only if there is none yet."""
        draft, final = self._at(f"{self.path}/snapshots/.{uuid.uuid4().hex}"), self._at(f"{self.path}/snapshots/{n}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            return False
        return True

    def commit(self, rows: DataFrame, tries: int = 20) -> int:
        """Adds the rows whose keys aren't there yet, all or none; returns how many."""
        known = self.version()
        have = self.read(known)
        folder = f"data/{uuid.uuid4().hex}"
        new = rows if have is None else rows.join(have.select(*self.keys).distinct(), list(self.keys), "left_anti").select(*rows.columns)
        new.write.parquet(f"{self.path}/{folder}")
        for _ in range(tries):
            mine = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
            n = mine.count()
            if not n:
                return 0
            if self._put(known + 1, [*self.folders(known), folder]):
                return n
            # Another writer was first: what it added since may hold keys of ours.
            before, known = set(self.folders(known)), self.version()
            added = [f for f in self.folders(known) if f not in before]
            theirs = self.spark.read.parquet(*(f"{self.path}/{f}" for f in added)).select(*self.keys).distinct()
            folder = f"data/{uuid.uuid4().hex}"
            mine.join(theirs, list(self.keys), "left_anti").select(*rows.columns).write.parquet(f"{self.path}/{folder}")
        raise RuntimeError(f"other writers were first {tries} times")
