"""Storage access on the driver through Hadoop's file systems, for any path that Spark can read."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import SparkSession


#: Schemes whose rename is atomic and refuses a name that exists.
EXCLUSIVE_RENAME = {"hdfs", "webhdfs", "viewfs", "abfs", "abfss"}


@dataclass(frozen=True, order=True)
class FileMeta:
    path: str
    modified: int
    size: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


class Files:
    """Listing, whole-file reads and put-if-absent writes under one table root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString()
        self.scheme = urlsplit(self.root).scheme

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path) or path.startswith("/") else f"{self.root}/{path}")

    def list(self, folder: str) -> list[FileMeta]:
        """Files in a folder, by name; none if it doesn't exist."""
        where = self._path(folder)
        if not self.fs.exists(where):
            return []
        found = [FileMeta(s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in self.fs.listStatus(where) if s.isFile()]
        return sorted(found, key=lambda f: f.name)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, overwrite: bool = True) -> None:
        out = self.fs.create(self._path(path), overwrite)
        try:
            out.write(data)
        finally:
            out.close()

    def put_if_absent(self, path: str, data: bytes) -> bool:
        """Write a whole file under a name that must be free; False if it is taken.  Readers never see half a file.

        Where neither a hard link nor an atomic rename gives that, as on object stores, nothing is written and an error
        is raised: commits there go through a committer of their own.
        """
        if self.scheme != "file" and self.scheme not in EXCLUSIVE_RENAME:
            raise OSError(f"{self.scheme}: has no atomic way to write a file only if it is absent")
        target = self._path(path)
        self.fs.mkdirs(target.getParent())
        temp = self._path(f"{target.getParent().toString()}/.{uuid.uuid4().hex}.tmp")
        self.write(temp.toString(), data)
        try:
            if self.scheme == "file":  # a hard link refuses a name that exists; a local rename would replace it
                os.link(unquote(urlsplit(temp.toString()).path), unquote(urlsplit(target.toString()).path))
                return True
            return bool(self.fs.rename(temp, target))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(temp, False)

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()


def spark_uri(path: str) -> str:
    """A path as ``_metadata.file_path`` spells it, but with one slash after ``file:``."""
    if path.startswith("/"):
        path = "file:" + path
    scheme, _, rest = path.partition(":")
    rest = "".join(c if ord(c) > 127 else quote(c, safe="/:@!$&'()*+,;=~-._") for c in rest)
    return f"{scheme}:{'/' + rest.lstrip('/') if scheme == 'file' else rest}"


def encode_path(path: str) -> str:
    """A relative path as the log stores it: a URI reference."""
    return quote(path, safe="/=:@!$&'()*+,;~-._")


def absolute(root: str, logged: str) -> str:
    """The readable path of a logged one, which is relative to the root or a whole URI, and encoded in either case."""
    plain = unquote(logged)
    return plain if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/", plain) or plain.startswith("/") else f"{root}/{plain}"


def relative(root: str, path: str) -> str:
    """A logged path for a file that may lie under the root."""
    local = lambda p: re.sub(r"^file:/+", "/", p)
    inside, base = unquote(local(path)), local(root).rstrip("/") + "/"
    return encode_path(inside[len(base) :]) if inside.startswith(base) else path
