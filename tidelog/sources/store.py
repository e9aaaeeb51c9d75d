"""Containers and manifests on a shared file system.

A version of a collection is a manifest: a small JSON file that names the containers, each a folder of Parquet files sorted
by key.  Writers add a folder and then create the next manifest; creating a file that exists fails, so of two writers one
loses with VersionConflict and may try again.  Readers see whole versions only.  Files go through Spark's file systems, so
any path that Spark reads will do.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import VersionConflict
from .oplog import SCHEMA

#: Keys that readers can rule files out by.
BLOOM = {"parquet.bloom.filter.enabled#key": "true"}
BLOOM_MIN_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; /tmp only where they are one process."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (top or "/tmp/checkpoints").rstrip("/")


class Files:
    """The few file operations that manifests need."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """False if the file exists.  The text appears whole, and of two writers one wins: it is written beside and then
        takes its name by a link (local files) or a rename, which fails if the name is taken (HDFS; a plain object store
        without such a rename needs a committer)."""
        p, fs = self._path(path)
        if fs.exists(p):
            return False
        beside, _ = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(beside.toUri().getPath(), p.toUri().getPath())
                return True
            return bool(fs.rename(beside, p))
        except FileExistsError:
            return False
        finally:
            if fs.exists(beside):
                fs.delete(beside, False)

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)


class Store:
    """The containers of one collection."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def manifest(self) -> dict:
        """version, containers [{id, folder, entries, bytes, max_seq}] and batches (of streams) of the newest version."""
        names = [n for n in self.files.names(self.path) if n.startswith("manifest-") and n.endswith(".json")]
        return json.loads(self.files.read(f"{self.path}/{names[-1]}")) if names else {"version": -1, "containers": [], "batches": {}}

    def commit(self, was: dict, containers: list[dict], batches: dict | None = None) -> dict:
        new = {"version": was["version"] + 1, "containers": containers, "batches": batches if batches is not None else was["batches"]}
        if not self.files.create(f"{self.path}/manifest-{new['version']:012d}.json", json.dumps(new)):
            raise VersionConflict(f"version {new['version']} of {self.path}")
        return new

    def write(self, log: DataFrame, container_id: int, bloom: bool = False) -> dict | None:
        """A container of ``log``, sorted by hash and key; None if there are no entries."""
        folder = f"container-{container_id:012d}-{uuid.uuid4().hex[:8]}"
        rows = log.withColumn("container_id", F.lit(container_id).cast("int")).select(*SCHEMA.names)
        # files hold ranges of hashes, so a reader of a key or a range of hashes opens few of them
        writer = rows.repartitionByRange("key_hash", "key").sortWithinPartitions("key_hash", "key").write
        if bloom:
            writer = writer.options(**BLOOM)
        writer.parquet(f"{self.path}/{folder}")
        size = F.sum((32 + F.octet_length("key") + F.octet_length("data")).cast("long"))
        got = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}").agg(F.count("*").alias("n"), size.alias("b"), F.max("seq").alias("s")).first()
        if not got.n:
            self.files.delete(f"{self.path}/{folder}")
            return None
        return {"id": container_id, "folder": folder, "entries": got.n, "bytes": got.b, "max_seq": got.s}

    def read(self, manifest: dict | None = None, ids: set[int] | None = None) -> DataFrame:
        """The raw log of a version, or of some of its containers."""
        listed = (manifest or self.manifest())["containers"]
        paths = [f"{self.path}/{c['folder']}" for c in listed if ids is None or c["id"] in ids]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def sizes(self, manifest: dict | None = None, collection: str = "") -> DataFrame:
        rows = [(collection, c["id"], c["entries"], c["bytes"]) for c in (manifest or self.manifest())["containers"]]
        return self.spark.createDataFrame(rows, "collection string, container_id int, entries bigint, bytes bigint")
