"""Versions of a set of Parquet tables, published by one small pointer.

A commit writes new folders, then its pointer to a hidden file, and then renames that to its
version's name, which must not exist yet: of two writers from one version exactly one
succeeds, and a pointer is never seen before it is whole, or at all if its writer died. The
file system must rename in one step (HDFS does; an object store without such a rename needs a
lock beside it). Readers of older versions aren't disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit was first."""


class SnapshotStore:
    """Tables under a path that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The latest published version; 0 if there is none."""
        fs, p = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.path}/versions/{version}").collect()
        return {name: self.spark.read.parquet(folder) for name, folder in (line[0].split("\t") for line in lines)}

    def commit(self, base: int, tables: dict[str, DataFrame]) -> int:
        """Publish ``tables`` as the version after ``base``; those not given stay as they were."""
        kept = {}
        if base:
            kept = dict(line[0].split("\t") for line in self.spark.read.text(f"{self.path}/versions/{base}").collect())
        for name, df in tables.items():
            folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            kept[name] = folder
        if self.version() != base:
            raise Conflict(f"version {base} isn't the latest")
        self._publish(base + 1, "".join(f"{name}\t{folder}\n" for name, folder in sorted(kept.items())))
        return base + 1

    def _publish(self, version: int, text: str) -> None:
        fs, hidden = self._fs(f"{self.path}/versions/.{version}-{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(text.encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{version}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri() if hidden.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # don't overwrite
        try:
            files.rename(hidden, pointer, never)
        except Exception as e:
            fs.delete(hidden, False)
            raise Conflict(f"version {version} was published meanwhile") from e
