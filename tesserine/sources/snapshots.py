"""Versions of tables in one folder, made visible in two phases.

A run first stages what it has made (whole Parquet tables and a pending manifest);
nothing that readers see changes.  Commit moves the manifest to its place with
one rename, which is the only step that makes a version current.  A run that dies
before leaves the old version in force and can be staged again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .incremental import changes


class Snapshots:
    """Committed versions of named tables under ``root``, a folder of any store that Spark reaches; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _numbers(self, folder: str, suffix: str) -> list[int]:
        if not self._fs.exists(self._path(folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return sorted(int(n.removesuffix(suffix)) for n in names if n.removesuffix(suffix).isdigit())

    def _manifest(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: dict) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """All committed versions; the last one is current."""
        return self._numbers("commits", ".json")

    def current(self) -> int | None:
        return (self.versions() or [None])[-1]

    def pending(self) -> int | None:
        """The staged version that is not committed, if any."""
        staged = [n for n in self._numbers("versions", "") if n > (self.current() or 0) and self._fs.exists(self._path(f"versions/{n}/pending.json"))]
        return staged[-1] if staged else None

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """Names of a committed version's tables with their ``folder`` and ``schema``; empty before the first commit and after a reset."""
        version = self.current() if version is None else version
        return {} if version is None else self._manifest(f"commits/{version}.json")["tables"]

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of the current (or a named) committed version, or None."""
        held = self.tables(version).get(name)
        return None if held is None else self._open(held)

    def _open(self, held: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{self.root}/{held['folder']}")

    def facts(self, version: int | None = None) -> dict:
        """The small facts staged with a committed version."""
        version = self.current() if version is None else version
        return {} if version is None else self._manifest(f"commits/{version}.json").get("facts", {})

    def stage(self, new: dict[str, DataFrame], keep: Iterable[str] = (), partition_by: dict[str, list[str]] | None = None, facts: dict | None = None) -> int:
        """Phase one: write ``new`` beside the current version, which stays in force; ``keep`` names tables carried over as they are, ``facts`` go into the manifest.

        What an earlier run staged and did not commit is replaced, so a crashed run is simply run again.
        """
        version, held = (self.current() or 0) + 1, self.tables()
        self._fs.delete(self._path(f"versions/{version}/pending.json"), False)
        named = {name: held[name] for name in keep}
        for name, df in new.items():
            folder = f"versions/{version}/{name}"
            df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{self.root}/{folder}")
            named[name] = {"folder": folder, "schema": df.schema.jsonValue()}
        self._write(f"versions/{version}/pending.json", {"version": version, "tables": named, "facts": facts or {}})
        return version

    def commit(self) -> int | None:
        """Phase two: make the staged version current by one rename; nothing to do if none is staged."""
        version = self.pending()
        if version is None:
            return None
        self._fs.mkdirs(self._path("commits"))
        if not self._fs.rename(self._path(f"versions/{version}/pending.json"), self._path(f"commits/{version}.json")):
            raise RuntimeError(f"version {version} of {self.root} could not be committed")
        return version

    def staged(self, name: str) -> DataFrame | None:
        """A table of the staged version."""
        version = self.pending()
        return None if version is None else self._open(self._manifest(f"versions/{version}/pending.json")["tables"][name])

    def discard(self) -> None:
        """Drop what is staged; the current version stays."""
        version = self.pending()
        if version is not None:
            self._fs.delete(self._path(f"versions/{version}"), True)

    def reset(self) -> int:
        """Forget all state: the new current version has no tables, so the next run sees everything as new."""
        self.discard()
        self.stage({})
        return self.commit()

    def vacuum(self) -> None:
        """Delete folders that the current version does not name; readers of older versions must be done."""
        used = {held["folder"] for held in self.tables().values()}
        for n in self._numbers("versions", ""):
            if n <= (self.current() or 0):
                for status in self._fs.listStatus(self._path(f"versions/{n}")):
                    if f"versions/{n}/{status.getPath().getName()}" not in used:
                        self._fs.delete(status.getPath(), True)


def fingerprint(spark: SparkSession, path: str, listed: int = 10_000) -> str:
    """A digest of a table's files that changes when the table does: their names, lengths and times, or, above ``listed`` files, their number and total length and the folder's time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    total, top = fs.getContentSummary(where), fs.getFileStatus(where)
    seen = hashlib.md5(f"{path} {total.getFileCount()} {total.getLength()} {top.getModificationTime()}".encode())
    at = [where] if total.getFileCount() <= listed else []
    while at:
        for status in sorted(fs.listStatus(at.pop()), key=lambda s: s.getPath().toString()):
            if status.isDirectory():
                at.append(status.getPath())
            seen.update(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()


def detect(store: Snapshots, files: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Stage ``files`` (``path, content_hash``) as the next state and return what changed since the committed one.

    ``also`` (``path``) names files that a version-control diff lists.  Without
    ``store.commit()`` the state stays as it was, and the next call finds the same
    changes again.  The first run, and the first after a reset, finds every file ADDED.
    """
    before = store.read("files")
    store.stage({"files": files.select("path", "content_hash")})
    after = store.staged("files")
    return changes(after.limit(0) if before is None else before, after, also)
