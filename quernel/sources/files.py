"""File operations through Hadoop's file systems, so that a path may be local or in any store Spark reads."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

#: What a file is called until it is whole.
PARTIAL = "_partial-"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def listed(self, folder: str) -> list[tuple[str, str, float]]:
        """(name, full URI, seconds since 1970 when it was written) of what is in a folder."""
        if not self.exists(folder):
            return []
        return sorted((s.getPath().getName(), s.getPath().toString(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(folder)))

    def names(self, folder: str) -> list[str]:
        return [name for name, *_ in self.listed(folder)]

    def files(self, folder: str, suffix: str) -> list[str]:
        """Full URIs of the data files in a folder."""
        return [uri for name, uri, _ in self.listed(folder) if name.endswith(suffix)]

    def read(self, name: str) -> str:
        return self.read_bytes(name).decode()

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, name: str, data: str | bytes) -> bool:
        """Write a file that does not exist yet; False if another writer was first.  Readers see it whole or not at all: it
        is written under another name and renamed, which fails where the name is taken."""
        path = self._path(name)
        if self._fs.exists(path):
            return False
        partial = self._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"{PARTIAL}{uuid.uuid4().hex}")
        self._fs.mkdirs(path.getParent())
        stream = self._fs.create(partial, False)
        try:
            stream.write(bytearray(data.encode() if isinstance(data, str) else data))
        finally:
            stream.close()
        try:
            return self._name(partial, path)
        finally:
            self._fs.delete(partial, False)

    def _name(self, partial, path) -> bool:
        whole = self._fs.makeQualified(path).toString()
        if urlparse(whole).scheme == "file":
            # a local rename would replace what is there; a second link to the file is refused
            local = lambda p: unquote(urlparse(self._fs.makeQualified(p).toString()).path)
            try:
                os.link(local(partial), local(path))
            except FileExistsError:
                return False
            except OSError:  # no links here: the next best
                return not self._fs.exists(path) and self._fs.rename(partial, path)
            return True
        try:
            return self._fs.rename(partial, path)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def delete_file(self, uri: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(uri), False)

    def delete_folder_of(self, uri: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(uri).getParent(), True)
