"""Small files of metadata: on a local path, or on any store that Hadoop's file systems reach.

Data files never pass through here: Spark writes and reads them.
"""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import quote, urlparse

from pyspark.sql import SparkSession

from siltstone.errors import CommitFailed, ValidationError


class LocalStore:
    """Files below a local folder, which all executors must see under the same path."""

    def __init__(self, root: str) -> None:
        path = urlparse(root).path if root.startswith("file:") else root
        self.root = os.path.abspath(path)
        if quote(self.root) != self.root:
            raise ValidationError(f"{self.root}: a table's folder needs plain characters, else Spark spells it in two ways")
        #: The root as Spark's file metadata spells it.
        self.uri = f"file://{self.root}"

    def _at(self, name: str) -> str:
        return os.path.join(self.root, name)

    def read(self, name: str) -> str | None:
        """The text of a file; None if it isn't there."""
        try:
            with open(self._at(name), encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def write(self, name: str, text: str) -> None:
        """Write a new file."""
        os.makedirs(os.path.dirname(self._at(name)), exist_ok=True)
        with open(self._at(name), "w", encoding="utf-8") as f:
            f.write(text)

    def publish(self, name: str, text: str) -> None:
        """Create a file with all of its content or not at all; CommitFailed if it is there already.

        A hard link is made to a finished temporary file: the link call creates or fails, it never replaces.
        """
        temp = f"{os.path.dirname(name)}/{uuid.uuid4().hex}.metadata.json"
        self.write(temp, text)
        try:
            os.link(self._at(temp), self._at(name))
        except OSError as e:
            raise CommitFailed(f"{name} can't be published: {e}") from e
        finally:
            os.unlink(self._at(temp))

    def replace(self, name: str, text: str) -> None:
        """Replace a file in one step."""
        temp = f"{name}.{uuid.uuid4().hex}"
        self.write(temp, text)
        os.replace(self._at(temp), self._at(name))

    def list(self, folder: str = "") -> list[tuple[str, int, int]]:
        """Name below the root, size and modification time (ms) of every file under a folder."""
        out = []
        for d, _, names in os.walk(self._at(folder)):
            for n in names:
                try:
                    s = os.stat(os.path.join(d, n))
                except FileNotFoundError:
                    continue  # another writer's temporary file
                out.append((os.path.relpath(os.path.join(d, n), self.root), s.st_size, int(s.st_mtime * 1000)))
        return out

    def exists(self, name: str) -> bool:
        return os.path.exists(self._at(name))

    def delete(self, name: str) -> bool:
        """Remove a file; False if it wasn't there."""
        try:
            os.unlink(self._at(name))
        except FileNotFoundError:
            return False
        return True

    def drop(self) -> bool:
        """Remove everything."""
        if not os.path.isdir(self.root):
            return False
        shutil.rmtree(self.root)
        return True


class HadoopStore:
    """The same on a store of Hadoop's, such as hdfs, through the driver's JVM.

    ``publish`` relies on the store's rename refusing an existing target, as hdfs does; object stores
    without such a rename need a committer of their own.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.uri = self.root = root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def publish(self, name: str, text: str) -> None:
        temp = f"{os.path.dirname(name)}/{uuid.uuid4().hex}.metadata.json"
        self.write(temp, text)
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(temp), self._at(name)):
            self._fs.delete(self._at(temp), False)
            raise CommitFailed(f"{name} is there already")

    def replace(self, name: str, text: str) -> None:
        self.write(name, text)

    def list(self, folder: str = "") -> list[tuple[str, int, int]]:
        if not self._fs.exists(self._at(folder)):
            return []
        files, out = self._fs.listFiles(self._at(folder), True), []
        base = self._fs.makeQualified(self._at("")).toString().rstrip("/")
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString()[len(base) + 1 :], f.getLen(), f.getModificationTime()))
        return out

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(name), False)

    def drop(self) -> bool:
        return self._fs.delete(self._at(""), True)


def store_for(spark: SparkSession, location: str) -> LocalStore | HadoopStore:
    """The store of a location: local for file: URIs, and for plain paths where the cluster's default store is local."""
    scheme = urlparse(location).scheme
    if not scheme:
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        scheme = urlparse(default).scheme
        location = location if scheme == "file" else f"{default.rstrip('/')}{location}"
    return LocalStore(location) if scheme == "file" else HadoopStore(spark, location)
