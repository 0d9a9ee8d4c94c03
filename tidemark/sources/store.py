"""File operations that commits need, on whatever store holds the tables."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Files:
    """Listing, atomic creation and deletion below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, jvm = spark, spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        top = self._path(root)
        self._store = top.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(top.toUri(), conf)
        # Renaming must fail if the target exists.
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename", True, jvm.Thread.currentThread().getContextClassLoader())
        self._plain = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        jvm.java.lang.reflect.Array.set(self._plain, 0, kind.getField("NONE").get(None))

    def names(self, folder: str) -> list[str]:
        return list(self.sizes(folder))

    def sizes(self, folder: str) -> dict[str, int]:
        """Bytes by name of what lies in a folder; none if there is no such folder."""
        path = self._path(folder)
        found = self._store.listStatus(path) if self._store.exists(path) else []
        return {s.getPath().getName(): s.getLen() for s in found}

    def exists(self, path: str) -> bool:
        return self._store.exists(self._path(path))

    def create_once(self, path: str, text: str) -> None:
        """The file with this text, whole or not at all; a file that is there already is a conflict."""
        aside = f"{path}.{uuid.uuid4().hex}.new"
        out = self._store.create(self._path(aside))
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._context.rename(self._path(aside), self._path(path), self._plain)
        except Py4JJavaError as error:
            self._store.delete(self._path(aside), False)
            if self.exists(path):
                raise Conflict(path) from error
            raise

    def delete(self, path: str) -> None:
        self._store.delete(self._path(path), True)
