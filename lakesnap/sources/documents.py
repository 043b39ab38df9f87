"""Small documents (JSON, pointers) in any store that Hadoop's file systems reach. Used on the driver only."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession

from lakesnap.errors import Conflict, NotFound

T = TypeVar("T")


def retry(work: Callable[[], T], attempts: int = 3, delay: float = 1.0, backoff: float = 2.0, errors: tuple = (OSError,)) -> T:
    """work(), again after errors; the last error is raised."""
    for n in range(attempts):
        try:
            return work()
        except errors:
            if n == attempts - 1:
                raise
            time.sleep(delay * backoff**n)
    raise ValueError("attempts must be positive")


class Store:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def qualified(self, path: str) -> str:
        """With the scheme of its store, as Spark names files there."""
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> bytes:
        """The bytes of a document; errors of the store are tried again, a document that isn't there is not."""
        return retry(lambda: self._read(path), errors=(Py4JJavaError, OSError))

    def _read(self, path: str) -> bytes:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise NotFound(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_json(self, path: str) -> dict[str, Any]:
        return json.loads(self.read(path))

    def write(self, path: str, data: bytes, overwrite: bool = False) -> None:
        """Readers see the whole document or none: it is written beside, then renamed. Without overwrite, one of several
        writers gets its document there, and the others a Conflict."""
        fs, p = self._at(path)
        if not overwrite and fs.exists(p):
            raise Conflict(path)
        fs.mkdirs(p.getParent())
        beside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{time.time_ns()}")
        out = fs.create(beside, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if not overwrite and fs.getScheme() == "file":  # a rename there replaces what it finds; a link does not
            files, at = self.jvm.java.nio.file.Files, self.jvm.java.io.File
            try:
                files.createLink(at(fs.makeQualified(p).toUri().getPath()).toPath(), at(fs.makeQualified(beside).toUri().getPath()).toPath())
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e):
                    raise Conflict(path) from e
                raise
            finally:
                fs.delete(beside, False)
            return
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = SparkContext._gateway.new_array(option, 1)
        how[0] = option.OVERWRITE if overwrite else option.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf).rename(beside, p, how)
        except Exception as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(path) from e
            raise

    def write_json(self, path: str, value: dict[str, Any], overwrite: bool = False) -> None:
        self.write(path, json.dumps(value, indent=2).encode(), overwrite)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def replace(self, path: str, to: str) -> None:
        """Puts a folder in the place of another, which goes only when it is there."""
        fs, target = self._at(to)
        old = None
        if fs.exists(target):
            old = self.jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{time.time_ns()}")
            if not fs.rename(target, old):
                raise OSError(f"{to} could not be moved")
        if not fs.rename(self.jvm.org.apache.hadoop.fs.Path(path), target):
            if old is not None:
                fs.rename(old, target)
            raise OSError(f"{path} could not be moved")
        if old is not None:
            fs.delete(old, True)

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files in a folder."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
