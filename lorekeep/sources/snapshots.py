"""Versioned tables in a folder: immutable content-addressed parts, a JSON manifest, an atomic pointer.

Parts are Parquet files written by Spark, one folder for each content digest; a
version that changes few partitions writes only those. The pointer is renamed
over by one writer at a time: whoever finds another version than expected
merges and tries again. On a local file system the pointer is one file under a
lock; on others (anything Spark reaches) each version is a numbered file, and
whoever renames to a number first has published it.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import merged


class PublicationConflict(RuntimeError):
    """Another version has been published meanwhile."""


class FileStore:
    """Small objects in a folder with compare-and-swap."""

    def __init__(self, folder: str, most_bytes: int = 1 << 30) -> None:
        self.folder, self.most_bytes = Path(folder), most_bytes
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, name: str) -> Path:
        path = (self.folder / name).resolve()
        if self.folder.resolve() not in path.parents:
            raise ValueError(f"outside the store: {name}")
        return path

    def get(self, name: str) -> tuple[bytes, str] | None:
        """Content and its tag; None if there is none."""
        path = self._path(name)
        if not path.exists():
            return None
        if path.stat().st_size > self.most_bytes:
            raise ValueError(f"{name} is larger than {self.most_bytes} bytes")
        data = path.read_bytes()
        return data, hashlib.sha256(data).hexdigest()

    def put(self, name: str, data: bytes, expected: str | None) -> str:
        """Write if the present content has the expected tag (None: there is none yet)."""
        path = self._path(name)
        path.parent.mkdir(parents=True, exist_ok=True)
        with (self.folder / ".lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            now = self.get(name)
            if (now and now[1]) != expected:
                raise PublicationConflict(name)
            part = path.with_name(f".{path.name}.{os.getpid()}")
            with part.open("wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, path)
        return hashlib.sha256(data).hexdigest()


class HadoopStore:
    """Small objects on any file system of Spark, each version a numbered file; rename onto an existing name must fail there."""

    def __init__(self, spark: SparkSession, folder: str, most_bytes: int = 1 << 30) -> None:
        self.jvm, self.folder, self.most_bytes = spark._jvm, folder.rstrip("/"), most_bytes
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def get(self, name: str) -> tuple[bytes, str] | None:
        """The latest version's content, and its number."""
        where = self._path(f"{name}.versions")
        found = [x.getPath().getName() for x in self.fs.listStatus(where)] if self.fs.exists(where) else []
        numbers = sorted(n for n in found if n.isdigit())
        if not numbers:
            return None
        path = self._path(f"{name}.versions/{numbers[-1]}")
        if self.fs.getFileStatus(path).getLen() > self.most_bytes:
            raise ValueError(f"{name} is larger than {self.most_bytes} bytes")
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()), numbers[-1]
        finally:
            stream.close()

    def put(self, name: str, data: bytes, expected: str | None) -> str:
        now = self.get(name)
        if (now and now[1]) != expected:
            raise PublicationConflict(name)
        number = f"{int(expected or 0) + 1:020d}"
        part = self._path(f"{name}.versions/.{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        target = self._path(f"{name}.versions/{number}")
        if self.fs.exists(target) or not self.fs.rename(part, target):
            self.fs.delete(part, False)
            raise PublicationConflict(name)
        return number


def open_store(uri: str, spark: SparkSession | None = None) -> FileStore | HadoopStore:
    """``file:///folder`` on this machine, or a folder of any other scheme that ``spark`` reaches."""
    scheme, _, rest = uri.partition("://")
    if "?" in rest or "#" in rest or scheme == "file" and not rest.startswith("/") or not rest:
        raise ValueError(f"not the URI of a folder: {uri}")
    if scheme == "file":
        return FileStore(rest)
    if spark is None:
        raise ValueError(f"a session is needed for {uri}")
    return HadoopStore(spark, uri)


class Snapshots:
    """The versions of one table."""

    def __init__(self, spark: SparkSession, uri: str, key: str, partitions: int = 16) -> None:
        self.spark, self.store, self.key, self.partitions = spark, open_store(uri, spark), key, partitions
        self.parts = f"{uri.rstrip('/')}/parts"

    def manifest(self) -> tuple[dict, str | None]:
        found = self.store.get("latest.json")
        return (json.loads(found[0]), found[1]) if found else ({"parts": {}, "schema": None}, None)

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """The rows of a version (the latest): a scan pinned to its parts."""
        manifest = manifest or self.manifest()[0]
        if not manifest["parts"]:
            return None
        folders = [f"{self.parts}/{d}" for d in sorted(set(manifest["parts"].values()))]
        return self.spark.read.parquet(*folders)

    def _digests(self, parted: DataFrame) -> dict[str, str]:
        """A digest of each partition's rows, whatever their order: one number pair for each comes to the driver."""
        row = F.xxhash64(F.to_json(F.struct(*sorted(c for c in parted.columns if c != "_part")), {"ignoreNullFields": "false"}))
        other = F.xxhash64(F.lit(1), F.to_json(F.struct(*sorted(c for c in parted.columns if c != "_part")), {"ignoreNullFields": "false"}))
        sums = parted.groupBy("_part").agg(F.sum(row.cast("decimal(38,0)")).alias("a"), F.sum(other.cast("decimal(38,0)")).alias("b"), F.count("*").alias("n"))
        return {str(r._part): hashlib.sha256(f"{r.a}|{r.b}|{r.n}|{parted.schema.json()}".encode()).hexdigest() for r in sums.collect()}

    def _written(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, changed: dict[int, str], parted: DataFrame) -> None:
        """The changed partitions, all in one job, put in place when it is done; a part counts by its marker, which comes last."""
        if not changed:
            return
        staging = f"{self.parts}/.staging-{uuid.uuid4().hex}"
        parted.where(F.col("_part").isin([*changed])).hint("rebalance", "_part").write.partitionBy("_part").parquet(staging)
        path = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path(staging).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for part, digest in changed.items():
            target = path(f"{self.parts}/{digest}")
            files.delete(target, True)  # what a broken write left
            if not files.rename(path(f"{staging}/_part={part}"), target):
                raise OSError(f"cannot put {digest} in place")
            files.create(path(f"{self.parts}/{digest}/_SUCCESS"), True).close()
        files.delete(path(staging), True)

    def publish(self, rows: DataFrame, expected: str | None) -> dict:
        """Write the changed partitions and move the pointer; a PublicationConflict if the latest version is not the expected one."""
        parted = rows.withColumn("_part", F.pmod(F.xxhash64(self.key), F.lit(self.partitions)))
        digests = self._digests(parted)
        self._write({int(part): digest for part, digest in digests.items() if not self._written(f"{self.parts}/{digest}")}, parted)
        manifest = {"format": 1, "parts": digests, "schema": rows.schema.json()}
        self.store.put("latest.json", json.dumps(manifest, sort_keys=True).encode(), expected)
        return manifest

    def damaged(self, manifest: dict | None = None) -> list[str]:
        """Partitions of a version whose rows no longer have the digest that they were published under."""
        manifest = manifest or self.manifest()[0]
        rows = self.read(manifest)
        found = {} if rows is None else self._digests(rows.withColumn("_part", F.pmod(F.xxhash64(self.key), F.lit(self.partitions))))
        return sorted(part for part, digest in manifest["parts"].items() if found.get(part) != digest)

    def reset(self, like: DataFrame) -> dict:
        """Publish an empty version; older ones stay readable by their manifests."""
        return self.publish(like.limit(0), self.manifest()[1])

    def commit(self, base: dict, ours: DataFrame, tries: int = 8) -> dict:
        """Publish changes made to version ``base``; changes of others are merged in, clashing ones raise."""
        for _ in range(tries):
            manifest, tag = self.manifest()
            now = self.read(manifest)
            then = self.read(base)
            empty = ours.limit(0)
            rows = ours if manifest == base else merged(empty if then is None else then, ours, empty if now is None else now, self.key)
            try:
                return self.publish(rows, tag)
            except PublicationConflict:
                continue
        raise PublicationConflict("latest.json")
