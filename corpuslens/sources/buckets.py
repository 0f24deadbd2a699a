"""Stored tables in buckets of their key: a commit rewrites the buckets that it touches and no others.

Below the table's folder, ``data/<commit>/bucket=<n>`` holds rows and ``commits/<version>`` the manifest of a version: the
folder of each bucket. A commit writes its buckets to a new folder and then moves its manifest into place, in one
rename; until then, and if the job dies before it, readers see the version before it, whole. Of two writers that began at the same
version the later one fails and can be run again. Folders of old versions stay for those who still read them, until ``vacuum``.

Cases: a table that was never written has no rows; a commit without rows to change makes no version; a bucket whose rows
are all removed leaves the manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.io import upsert_latest

MANIFEST = "bucket int, folder string"


class BucketedTable:
    """Rows by ``keys``, in ``buckets`` by a hash of ``by`` (the keys, or some of them)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path.rstrip("/"), keys, by or keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max((int(x) for x in self._names("commits")), default=0)

    def manifest(self, version: int) -> dict[int, str]:
        """The folder of each bucket: so many rows at most as there are buckets."""
        if not version:
            return {}
        return {r.bucket: r.folder for r in self.spark.read.schema(MANIFEST).json(f"{self.path}/commits/{version:09d}").collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{x}" for x in folders))

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one if none is given. Later commits don't change what it reads."""
        found = self.manifest(self.version() if version is None else version)
        return self._rows([found[b] for b in sorted(found)])

    def upsert(self, incoming: DataFrame, seq: str) -> int:
        """Rows of ``incoming`` replace those of their keys, unless these have a larger ``seq``. The version after it."""
        incoming = incoming.select(*self.schema.names)
        return self._commit(incoming, lambda stored: upsert_latest(stored, incoming, self.keys, seq))

    def remove(self, removed: DataFrame) -> int:
        """Without the rows whose ``by`` columns are among ``removed``. The version after it."""
        gone = removed.select(*self.by)
        return self._commit(gone, lambda stored: stored.join(gone, self.by, "left_anti"))

    def _commit(self, change: DataFrame, merge) -> int:
        before = self.version()
        manifest = self.manifest(before)
        touched = sorted(r.b for r in change.select(self._bucket().alias("b")).distinct().collect())  # ``buckets`` numbers at most
        if not touched:
            return before
        commit = uuid.uuid4().hex
        self._write(merge(self._rows([manifest[b] for b in touched if b in manifest])), commit)
        for b in touched:
            manifest.pop(b, None)
        written = [x for x in self._names(f"data/{commit}") if x.startswith("bucket=")]
        manifest |= {int(x.removeprefix("bucket=")): f"{commit}/{x}" for x in written}
        return self._publish(manifest, before + 1)

    def _write(self, rows: DataFrame, commit: str) -> None:
        # rebalanced by bucket: few files a bucket, and a bucket too large for a task is split
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{commit}")

    def _publish(self, manifest: dict[int, str], version: int) -> int:
        draft, place = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{version:09d}")
        self.spark.createDataFrame(sorted(manifest.items()), MANIFEST).coalesce(1).write.json(draft.toString())
        self._fs.mkdirs(place.getParent())
        # a rename onto a folder that is there would move into it: look first, and make sure after
        if self._fs.exists(place) or not self._fs.rename(draft, place) or self._fs.exists(self._path(place, draft.getName())):
            raise RuntimeError(f"version {version} was committed meanwhile; run again on the new one")
        return version

    def vacuum(self) -> None:
        """Delete the versions before the last one, and what no manifest names."""
        last = self.version()
        held = {x.split("/")[0] for x in self.manifest(last).values()}
        for x in self._names("commits"):
            if int(x) < last:
                self._fs.delete(self._path(f"{self.path}/commits/{x}"), True)
        for x in self._names("data"):
            if x not in held:
                self._fs.delete(self._path(f"{self.path}/data/{x}"), True)
