"""Numbered versions of a folder of tables; a version is made current by creating one small file that must not exist yet."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Versions:
    """The version files ``<root>/versions/<number>.json`` of a folder on any file system that Spark knows.

    Writers work in folders of their own and publish at the end. Of several who go for the same number one succeeds; the
    others see ``False`` and start again from what is current then. A reader never sees half a file.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, *names: str) -> bool:
        path = self._path(*names)
        return self._files(path).exists(path)

    def delete(self, *names: str) -> None:
        path = self._path(*names)
        self._files(path).delete(path, True)

    def numbers(self) -> list[int]:
        """All published versions, oldest first."""
        folder = self._path("versions")
        files = self._files(folder)
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, number: int) -> dict:
        path = self._path("versions", f"{number}.json")
        stream = self._files(path).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The current version and what was published with it; 0 and nothing before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def publish(self, number: int, content: dict) -> bool:
        """Make a version current; ``False`` if another writer has published one of this number."""
        target = self._path("versions", f"{number}.json")
        draft = self._path("versions", f".{uuid.uuid4().hex}")
        files = self._files(target)
        files.mkdirs(target.getParent())
        stream = files.create(draft, False)
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()
        try:
            uri = urlparse(files.makeQualified(target).toString())
            if uri.scheme == "file":
                # the local file system's rename replaces what is there; a second link does not
                try:
                    os.link(files.makeQualified(draft).toUri().getPath(), unquote(uri.path))
                except FileExistsError:
                    return False
                return True
            return not files.exists(target) and files.rename(draft, target)
        finally:
            files.delete(draft, False)
