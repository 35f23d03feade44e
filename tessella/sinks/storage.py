"""Stored files below one root, on any file system that Spark's session can open."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """put, get, exists and path of keys; a key that would leave the root is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, key: str) -> str:
        if not key or key.startswith("/") or ".." in key.split("/") or "\\" in key:
            raise ValueError(f"not a storage key: {key!r}")
        return f"{self.root}/{key}"

    def _open(self, key: str):
        at = self._jvm.org.apache.hadoop.fs.Path(self.path(key))
        return at.getFileSystem(self._conf), at

    def put(self, key: str, content: bytes) -> str:
        system, at = self._open(key)
        out = system.create(at, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return key

    def put_file(self, key: str, source: str) -> str:
        system, at = self._open(key)
        system.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(source), at)
        return key

    def get(self, key: str) -> bytes:
        system, at = self._open(key)
        if not system.exists(at):
            raise FileNotFoundError(key)
        stream = system.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        system, at = self._open(key)
        return system.exists(at)


def health(spark: SparkSession, tables: dict[str, str]) -> dict[str, bool]:
    """Whether the session answers, and which tables of {name: path} are there."""
    out = {"session": spark.range(1).count() == 1}
    for name, path in tables.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out[name] = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return out
