"""Bytes of files in any store that Spark reads, by the driver: heads, streams, copies."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

CHUNK = 8 << 20


class Store:
    """Files under paths as Spark takes them. Local ones go past Hadoop; paths without a scheme are local if the default store is."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.local_by_default = (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").startswith("file:")

    def _local(self, path: str) -> str | None:
        if path.startswith("file:"):
            return "/" + path[5:].lstrip("/")
        return path if "://" not in path and self.local_by_default else None

    def is_local(self, path: str) -> bool:
        return self._local(path) is not None

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        if local := self._local(path):
            return os.path.exists(local)
        fs, where = self._hadoop(path)
        return fs.exists(where)

    def is_folder(self, path: str) -> bool:
        if local := self._local(path):
            return os.path.isdir(local)
        fs, where = self._hadoop(path)
        return fs.exists(where) and fs.getFileStatus(where).isDirectory()

    def size(self, path: str) -> int:
        if local := self._local(path):
            return os.path.getsize(local)
        fs, where = self._hadoop(path)
        return fs.getFileStatus(where).getLen()

    def chunks(self, path: str, size: int = CHUNK) -> Iterator[bytes]:
        if local := self._local(path):
            with open(local, "rb") as f:
                while data := f.read(size):
                    yield data
            return
        fs, where = self._hadoop(path)
        stream = fs.open(where)
        try:
            while data := bytes(stream.readNBytes(size)):
                yield data
        finally:
            stream.close()

    def head(self, path: str, n: int) -> bytes:
        return next(self.chunks(path, n), b"")

    def write(self, path: str, chunks: Iterable[bytes]) -> None:
        if local := self._local(path):
            os.makedirs(os.path.dirname(os.path.abspath(local)), exist_ok=True)
            with open(local, "wb") as f:
                for data in chunks:
                    f.write(data)
            return
        fs, where = self._hadoop(path)
        stream = fs.create(where, True)
        try:
            for data in chunks:
                stream.write(bytearray(data))
        finally:
            stream.close()

    def opened(self, path: str):
        """A file for pyarrow: mapped if it is local, else read through Spark's store."""
        import pyarrow as pa

        if local := self._local(path):
            return pa.memory_map(local)
        return pa.BufferReader(b"".join(self.chunks(path)))

    def parts(self, folder: str) -> list[str]:
        """Data files of a written folder in the order of their partitions."""
        if local := self._local(folder):
            return [os.path.join(local, f) for f in sorted(os.listdir(local)) if f.startswith("part-")]
        fs, where = self._hadoop(folder)
        found = [str(s.getPath()) for s in fs.listStatus(where)]
        return sorted(f for f in found if f.rpartition("/")[2].startswith("part-"))

    def delete(self, path: str) -> None:
        fs, where = self._hadoop(path)
        fs.delete(where, True)

    def scratch(self, name: str) -> str:
        """A new path in the shared folder that the cluster names."""
        return f"{shared_folder(self.spark)}/rowforge-{uuid.uuid4().hex}/{name}"


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: ``spark.checkpoint.dir``. A temporary folder only if both are one process."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "rowforge")
