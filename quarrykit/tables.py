"""Tables as versioned folders behind manifests: commits rewrite the partitions they touch.

A table is a folder.  Its rows lie in ``buckets`` partitions by a hash of the key; a
partition's files are written once, into a folder of their own, and never changed.  A
manifest (``_manifests/<version>``, a line for each partition that has rows) names the
folders of one version.  A commit writes the partitions that its changes touch and then
creates the next manifest, which fails if another writer has made it first.  Readers take
the last manifest, so there is no moment without a table and none with half a commit;
files that no manifest names are litter of a writer that broke off, for :meth:`vacuum`.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import merge


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Table:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._lines = jvm.org.apache.commons.io.IOUtils

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(m[1]) for s in self._fs.listStatus(folder) if (m := re.fullmatch(r"(\d{12})", s.getPath().getName())))

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, str], str]:
        """Version, folder of each partition that has rows, and the mark of the commit; version 0 has none."""
        version = next(reversed(self.versions()), 0) if version is None else version
        if not version:
            return 0, {}, ""
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{version:012d}"))
        try:
            mark, *lines = self._lines.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        return version, {int(b): folder for b, folder in (line.split("\t") for line in lines if line)}, mark

    def _publish(self, version: int, folders: dict[int, str], mark: str) -> None:
        """The manifest is written aside and renamed: it is there whole or not at all, and once."""
        body = "\n".join([mark, *(f"{b}\t{f}" for b, f in sorted(folders.items()))])
        aside, at = self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}"), self._path(f"{self.path}/_manifests/{version:012d}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, False)
            raise CommitConflict(f"{self.path} has version {version} already")

    # Reading

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """Rows of a version (the last), of some partitions only if asked; None before the first commit."""
        version, folders, _ = self.manifest(version)
        wanted = [f for b, f in sorted(folders.items()) if only is None or b in only]
        if not version:
            return None
        if not wanted:
            some = next(iter(folders.values()), None)
            return None if some is None else self.spark.read.parquet(f"{self.path}/{some}").limit(0)
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in wanted])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # Writing

    def commit(self, rows: DataFrame, touched: list[int], base: int, mark: str = "") -> int:
        """Rows become all that the touched partitions hold; base is the version that they were worked out from."""
        version, folders, _ = self.manifest(base) if base else (0, {}, "")
        folder = f"v{version + 1:012d}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = {int(m[1]) for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if (m := re.fullmatch(r"_bucket=(\d+)", s.getPath().getName()))}
        kept = {b: f for b, f in folders.items() if b not in touched}
        self._publish(version + 1, kept | {b: f"{folder}/_bucket={b}" for b in written}, mark)
        return version + 1

    def upsert(self, changes: DataFrame, mark: str = "", order: str | None = None) -> int:
        """Changes (of a key the last by order) merged in; a mark that the last commit has is not committed again."""
        base, _, last = self.manifest()
        if mark and mark == last:
            return base
        changes = merge.latest(changes, self.keys, order) if order else changes
        touched = [r["b"] for r in changes.select(self.bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        if not touched:
            return base
        old = self.read(base, touched) if base else None
        rows = changes if old is None else merge.upsert(old, changes, self.keys).drop("_action")
        return self.commit(rows, touched, base, mark)

    def delete(self, gone: DataFrame, mark: str = "") -> int:
        base, _, _ = self.manifest()
        touched = [r["b"] for r in gone.select(self.bucket().alias("b")).distinct().collect()]
        old = self.read(base, touched) if base and touched else None
        return base if old is None else self.commit(merge.delete_keys(old, gone, self.keys), touched, base, mark)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last keep, and folders that none of those names; no writer may be at work. Returns how many folders went."""
        versions = self.versions()
        named = {f.split("/")[0] for v in versions[-keep:] for f in self.manifest(v)[1].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_manifests/{v:012d}"), False)
        stale = [s.getPath() for s in self._fs.listStatus(self._path(self.path)) if re.fullmatch(r"v\d{12}-[0-9a-f]{32}", s.getPath().getName()) and s.getPath().getName() not in named]
        for p in stale:
            self._fs.delete(p, True)
        return len(stale)
