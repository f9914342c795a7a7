"""Keyed state tables on plain Parquet: hash buckets with versions of their own.

A row lives in the bucket of its key. A commit writes only the buckets it
touches, to a folder of its version, and then a manifest that names for every
bucket the versions it consists of. A reader takes the newest manifest below
its own version, so it sees no half-written commit, and a commit that is
delivered again replaces just its own folder and manifest.

``replace`` puts touched buckets anew (copy on write). ``append`` adds rows to
them without reading or rewriting what they hold, so a bucket with a very
frequent key costs its new rows only; ``compact`` folds long chains together.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket"


class BucketedTable:
    """``keys`` choose the bucket; the number of buckets is fixed by the first commit."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        newest = self._manifest()
        self.buckets = newest["buckets"] if newest else buckets

    # manifests

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        folder = self._path("_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, before: int | None = None) -> int | None:
        """The newest committed version (below ``before``)."""
        return max((v for v in self.versions() if before is None or v < before), default=None)

    def _manifest(self, before: int | None = None) -> dict | None:
        version = self.version(before)
        if version is None:
            return None
        stream = self._fs.open(self._path("_manifests", f"{version}.json"))
        try:
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        found["chains"] = {int(b): chain for b, chain in found["chains"].items()}
        return found

    def _put_manifest(self, version: int, schema: StructType, chains: dict[int, list[int]]) -> None:
        text = json.dumps({"buckets": self.buckets, "schema": schema.jsonValue(), "chains": chains})
        draft = self._path("_manifests", f"{version}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        final = self._path("_manifests", f"{version}.json")
        self._fs.delete(final, False)
        self._fs.rename(draft, final)

    # reading

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys in ``rows``; at most all bucket numbers reach the driver."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame | None:
        """Rows of the given buckets, or of all; None before the first commit."""
        manifest = self._manifest(before)
        if manifest is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        wanted = manifest["chains"] if buckets is None else buckets
        paths = [f"{self.path}/version={v}/{BUCKET}={b}" for b in wanted for v in manifest["chains"].get(b, ())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # writing

    def _write(self, rows: DataFrame, version: int) -> set[int]:
        folder = f"{self.path}/version={version}"
        rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.mode("overwrite").partitionBy(
            BUCKET).parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"version={version}"))]
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}

    def replace(self, rows: DataFrame, version: int, buckets: Iterable[int]) -> None:
        """``rows`` are from now on all rows of ``buckets``."""
        manifest = self._manifest(version)
        chains = dict(manifest["chains"]) if manifest else {}
        written = self._write(rows, version)
        for b in buckets:
            chains.pop(b, None)
        if not written <= set(buckets):
            raise ValueError("a row belongs to a bucket that is not replaced")
        chains.update({b: [version] for b in written})
        self._put_manifest(version, rows.schema, chains)

    def append(self, rows: DataFrame, version: int) -> None:
        """Add rows; their keys must not stand in the table where that matters to the reader."""
        manifest = self._manifest(version)
        chains = dict(manifest["chains"]) if manifest else {}
        for b in self._write(rows, version):
            chains[b] = [*chains.get(b, []), version]
        self._put_manifest(version, rows.schema, chains)

    def compact(self, version: int, longest: int = 8) -> list[int]:
        """Fold the buckets of more than ``longest`` parts, as a commit of ``version``."""
        manifest = self._manifest(version)
        long = [b for b, chain in (manifest["chains"].items() if manifest else ()) if len(chain) > longest]
        if long:
            self.replace(self.read(long, version), version, long)
        return long

    def vacuum(self, keep: int = 2) -> int:
        """Delete bucket folders that none of the newest ``keep`` versions uses; how many."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {(v, b) for k in kept for b, chain in self._manifest(k + 1)["chains"].items() for v in chain}
        deleted = 0
        for status in self._fs.listStatus(self._root) if versions else ():
            name = status.getPath().getName()
            # A folder above the newest manifest may be a commit under way.
            if not name.startswith("version=") or int(name.split("=")[1]) > versions[-1]:
                continue
            for child in self._fs.listStatus(status.getPath()):
                part = child.getPath().getName()
                if part.startswith(f"{BUCKET}=") and (int(name.split("=")[1]), int(part.split("=")[1])) not in used:
                    deleted += bool(self._fs.delete(child.getPath(), True))
        for v in versions[:-keep]:
            self._fs.delete(self._path("_manifests", f"{v}.json"), False)
        return deleted
