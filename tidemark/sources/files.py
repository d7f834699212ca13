"""Small files and folders of a store, through Hadoop's file systems."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """Operations below one root, all on paths as Spark takes them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, text: str):  # noqa: ANN201  a Hadoop path
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        """What lies directly in a folder; nothing if there is none."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def glob(self, pattern: str) -> list[str]:
        """Paths that fit a pattern."""
        return sorted(str(s.getPath()) for s in self.fs.globStatus(self.path(pattern)) or ())

    def state(self, path: str) -> tuple[tuple[str, int, int], ...]:
        """Name, size and time of every file below a path."""
        found, out = self.fs.listFiles(self.path(path), True), []
        while found.hasNext():
            f = found.next()
            out.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
        return tuple(sorted(out))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def delete_uri(self, uri: str) -> None:
        """A file by its escaped address, as a scan's metadata column has it."""
        self.fs.delete(self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI.create(uri)), False)

    def rename(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.path(target).getParent())
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} can't become {target}")

    def write(self, path: str, content: str) -> None:
        out = self.fs.create(self.path(path), True)
        out.write(bytearray(content.encode()))
        out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, content: str) -> bool:
        """A whole new file, or False if there is one already: of any number of writers one succeeds. Where a rename would replace the file (a local file system), it is linked instead."""
        aside = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        self.write(aside, content)
        try:
            if self.fs.getUri().getScheme() == "file":
                with contextlib.suppress(FileExistsError):
                    os.link(*(self.path(p).toUri().getPath() for p in (aside, path)))
                    return True
                return False
            return not self.exists(path) and self.fs.rename(self.path(aside), self.path(path))
        finally:
            self.delete(aside)
