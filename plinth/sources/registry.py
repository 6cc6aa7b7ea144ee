"""A catalogue of one folder's tables at one moment, shared by all who ask in a session.

The snapshot is the list of the tables' files with their lengths and times. Each table is read once; views that many
queries share are written once, in the folder that the executors share, under the snapshot's name, and found there again by later
sessions. When a file changes, refresh() makes a new snapshot, and the views of the old one are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .store import shared_dir


class Registry:
    shared: dict[tuple[str, str], Registry] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Registry:
        """The session's registry of a folder."""
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls.shared:
            cls.shared[key] = cls(spark, folder)
        return cls.shared[key]

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.read: dict[str, DataFrame] = {}
        self.snapshot = self.state()

    def listed(self, path: str) -> list:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return list(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at))

    def state(self) -> str:
        """A name for the files as they are: tables may be files, or folders of files."""
        seen, folders = [], [self.folder]
        while folders:
            for f in self.listed(folders.pop()):
                if f.isDirectory():
                    folders.append(f.getPath().toString())
                else:
                    seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:24]

    def table(self, name: str) -> DataFrame:
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.read[name]

    def home(self, snapshot: str) -> str:
        return f"{shared_dir(self.spark)}/plinth-views/{hashlib.sha256(self.folder.encode()).hexdigest()[:12]}-{snapshot}"

    def view(self, name: str, build: Callable[[Registry], DataFrame]) -> DataFrame:
        """The rows of build(self), computed once for a snapshot."""
        if f"view {name}" not in self.read:
            path = f"{self.home(self.snapshot)}/{name}"
            done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
                build(self).write.mode("overwrite").parquet(path)
            self.read[f"view {name}"] = self.spark.read.parquet(path)
        return self.read[f"view {name}"]

    def refresh(self) -> bool:
        """Look at the files again. True if any has changed: then tables are read anew, and the views of the old snapshot are deleted."""
        now, old = self.state(), self.snapshot
        if now == old:
            return False
        self.snapshot, self.read = now, {}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home(old))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return True
